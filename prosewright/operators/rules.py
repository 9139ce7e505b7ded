"""Wording rules over lines: rules are data, findings are rows.

A rule has an id, a severity, a pattern (Java syntax), an optional veto on what stands before or after the hit, and a scope:
``line`` rules see masked lines (quotations and code removed), ``raw`` rules the line itself.  Every rule of a family is
evaluated in one narrow pass; only lines that a family's prefilter matches are split into hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.text import all_quoted, drop_tail, final_consonant, fragment, hangul_count, is_example, is_narrative, is_plain_speech, mask, placed, sentences, squeeze, strip, strip_tags
from prosewright.operators import elements, intervals, patterns, structure


@dataclass(frozen=True)
class Rule:
    kind: str
    severity: str
    pattern: str
    note: str = ""
    unless: str = ""  # no hit if the line's part up to the hit's end matches this
    first_only: bool = False


# Word lists and patterns of the rules (Java syntax).
NOUN_TAIL = r"(?=[을를이가은는도만에서로라며\s·,.!?)\]」]|$)"
PARTICLES = r"(?:에서|에는|에도|까지|부터|으로|처럼|보다|밖에|조차|마저|에|서|를|을|가|는|은|도|만|로|와|과|의|이)"
EVALUATIVE = ["가벼운", "강력한", "유연한", "혁신적", "똑똑한", "직관적인", "손쉬운", "최적의", "풍부한", "탄탄한", "완벽한", "뛰어난", "압도적", "대대적", "획기적", "폭발적", "파격적", "막강한"]
AMOUNT = r"\d[\d.,]*(?:\s?~\s?\d[\d.,]*)?\s?(?:%p|%|퍼센트|배|명|건|개|곳|점|위|억|만|천)"
BIG = r"(?:월등히|훌쩍|압도적으로|현저히|급격히|급증|급감|폭증|폭락|급등|급락)"
SEAT = r"(?:걸리는|걸린|새는|도는|터지는|터진|터졌을|끊기는|끊긴|거치는|거친|띄우는|띄운|덧붙이는|지나가는|세는|갈리는|갈린|빠지는|빠진|쏟아지는|깨지는|깨진|멈추는|멈춘|나가는|먹는|붙는|푸는|넣을|넣는|가리키는|겹치는|섞이는|고치는|쉬운|비싼|어긋나는|튀는)\s*자리"
SEAT_ANY = r"[가-힣]{1,8}(?:는|은|던|을|린|긴|난|운|친|킨|싼)\s*자리"
SEAT_OK = r"(?:같은|제|자기|첫|앞|뒷|옆|빈|윗|아랫|앉는|드나드는)\s*자리$"
EMPTY_NOUN = r"(?:[가-힣]{1,8}(?:는|은|던|을|린|긴|난|운|친|킨|싼)\s*(?:판|창|결)|(?:앞|뒤|이번|저번|다음|지난|첫|새|매)\s*판|(?<![0-9가-힣])[1-9]\s*판)" + NOUN_TAIL
EMPTY_NOUN_OK = r"(?:(?:같은|한|다른|비슷한|고운|거친)\s*결|(?:뜨는|뜬|여는|연|닫는|닫은|띄우는|띄운|열리는|열린|닫히는|같은|다른|그)\s*창)$"
REACH_NOUN = r"(?:닿는|닿을|닿은|버는|무르는|가르는)\s*(?:값|축|판|창|층)" + NOUN_TAIL
COST_NOUN = r"(?<!마음에\s)(?<!눈에\s)(?<![가-힣])드는\s*값" + NOUN_TAIL
TIME_NOUN = r"(?:[가-힣]{1,6}(?:하|되)|묻|담|다루|보|쓰|재|부르|만드|바뀌|덮|그리|띄우|넘치|정해지|있)는\s*때"
DOUBLE_PASSIVE = r"(?:불리|쓰이|보이|나뉘|모이|짜이|갈리|닫히|열리|잊히|잘리)어[지진졌]|(?:불려|쓰여|보여|나뉘어|모아|짜여|갈려|닫혀|열려|잊혀|잘려)지[다는며면고게]|되어[지진졌]"
DOUBLE_PARTICLE = r"[가-힣](?:에서의|으로의|로의|에의|으로부터의|로부터의|에로의)"
NUMERAL = r"(?:(?:열|스물|서른|마흔)?(?:한|두|세|네|다섯|여섯|일곱|여덟|아홉)|열|스무|몇|여러)"
HEAD_ECHO = r"^\s*(?:[-*]\s+|\d+\.\s+)?([가-힣]{2,6})\s*(?:—|–|\s-)\s+(.+?)\s\1(?:함|합니다|됨|됩니다)?\s*[.。]?\s*$"
TRAILING_NAME = r"(?:니다|였다|했다|이다|됐다|된다|한다|됨|음|함|임)\s?\((?=[^)]*[A-Za-z])[A-Z0-9][A-Za-z0-9.&+'’\-]+(?:\s[A-Z0-9][A-Za-z0-9.&+'’\-]*){0,2}\)(?=[.。]?(?:\s|$))"
SECTION_REF = r"§\s?\d+(?:[.\-]\d+)*"
STANDARD_BEFORE = r"(?:\b[A-Z]{2,}[A-Z/]*[\s\-:]?\d[\d\-:./]*|(?<![.\w])[A-Za-z]*[a-z][A-Za-z]*[」\"”]?)\s*"
BARE_SECTION = r"(?<![A-Za-z0-9_.\-/:§])(?:\((\d{1,2}(?:[-.]\d{1,2})+)\)|\(?(\d{1,2}(?:[-.]\d{1,2})*)\s*절(?![가-힣])\)?)"
NOT_BUT = r"[가-힣]+(?:가|이)\s?아니라(?=\s)|것은\s?(?:아니다|아닙니다)|[가-힣]+인가,\s?[가-힣]+인가"
ATTACH = r"붙(?!여\s?넣|잡|들|박|임성|임새)(?!임\s*[\d\-:.])(?!\S{0,2}\s?(?:서술격\s?)?(?:조사|어미|접두사|접미사))"
ATTACH_OK = (
    r"(?:(?:덧|따라|달라|들러|맞|불|눌어|엉겨|복)|(?:갖다|이어)\s?"
    r"|(?:이름|별명|제목|태그|라벨|레이블|번호|꼬리표|딱지|스티커|포스트잇|주석|어노테이션|괄호|문구|명사|낱말|단어|글자|머리말|꼬리말|접두어|접두사|접미사|조사|어미|토씨"
    r"|옵션|플래그|기호|표시|표|파일|자료|문서|사본|서류|양식|종이|쪽지|메모|사진|그림|테이프|속도|탄력|가속|자신감|습관)\s?[을를이가은는도만]?\s?(?:[가-힣]{1,4}\s)?"
    r"|시험에\s?|(?:앞|뒤|끝|옆|벽|위|마지막)에\s?(?:\S{1,6}\s){0,2}|\s[을를이가]\s?|[a-z][을를이가은는도]?\s?|[\\/_)\]'\"`\-+#@%$&=][을를이가은는도]\s?)붙$"
)
ONLY_DEICTIC = rf"^\*{{0,2}}(?:아래|위쪽)\*{{0,2}}{PARTICLES}?\*{{0,2}}$"
BAD_LABELS = ["내용", "기타", "참고", "비고", "설명", "메모"]
META_HEADING = r"^(?:\d+(?:[.-]\d+)*[.)]?\s+)?(?:이\s?(?:문서|자료)(?:의|를)?\s*)?(?:읽는\s?(?:법|방법|순서)|읽기\s?전에|(?:문서|자료)\s?구성)$"

LINE_RULES = [
    Rule("empty_seat", "err", SEAT, first_only=True),
    Rule("empty_seat_suspect", "warn", SEAT_ANY, unless=SEAT_OK, first_only=True),
    Rule("invented_noun_phrase", "warn", EMPTY_NOUN, unless=EMPTY_NOUN_OK),
    Rule("invented_noun_phrase", "err", REACH_NOUN),
    Rule("invented_noun_phrase", "err", COST_NOUN),
    Rule("invented_noun_phrase", "err", TIME_NOUN, "without an analyser: by a list of stems"),
    Rule("evaluative_modifier", "warn", "|".join(EVALUATIVE)),
    Rule("evaluative_modifier", "warn", rf"{AMOUNT}[^\n.]{{0,6}}?(?:에\s?불과|에\s?그치|에\s?그쳤)|{BIG}[^\n.]{{0,20}}?{AMOUNT}|{AMOUNT}[^\n.]{{0,10}}?{BIG}"),
    Rule("vague_reference", "err", r"(?<![가-힣])(?:우리(?!나라)|이들|저들|얘네|쟤네|이쪽|그쪽|저쪽)", "without an analyser: at the head of a word"),
    Rule("deictic_check", "warn", r"(?<![가-힣])우리나라"),
    Rule("deictic_check", "warn", rf"(?<![가-힣])(?:여기|거기|저기|이것|그것|저것)(?:{PARTICLES}|(?=\s+[0-9A-Za-z가-힣]))"),
    Rule("wrong_term_session", "err", "회기(?!여|반)", unless=r"(?:조회\s*기간|사회기|(?:국회|이사회|총회|의회|위원회|정기|임시)\s*회기|기회기)$"),
    Rule("misread_word", "warn", rf"(?<![가-힣]){NUMERAL}\s+종이(?:다|며|고)?(?![가-힣])"),
    Rule("unfamiliar_term", "warn", r"(?<![가-힣])정본(?!화)"),
    Rule("non_business_word", "warn", r"잰\s+[가-힣]{1,3}|(?<![가-힣])쟀|재는\s*방법"),
    Rule("non_business_word", "err", ATTACH, unless=ATTACH_OK),
    Rule("head_echo", "warn", HEAD_ECHO),
    Rule("double_passive", "err", DOUBLE_PASSIVE, first_only=True),
    Rule("double_particle", "warn", DOUBLE_PARTICLE, unless=r"(?:경로|도로|회로|진로|통로|대로|선로|항로|수로|미로|플로|별로|서로|따로|새로|바로|주로|실로|종로)의$", first_only=True),
    Rule("calque_pronoun", "warn", "그녀", first_only=True),
    Rule("trailing_paren_name", "warn", TRAILING_NAME),
]

# Words that business writing does not have.
NON_BUSINESS = [
    ("err", r"(?:커밋|진행|로그|자료|기록|후보|의견|답변)[^\n]{0,10}걷(?!어\s*[내낸냄낼냈냅])"),
    ("err", r"(?:줄|말|한마디|프롬프트)\s*던지기|(?:줄|프롬프트)\s*(?:로|을|를|만)?\s*던(?:집|진|질|졌|져|지(?!기))"),
    ("err", r"(?:후보|목록|초안|결과)\s*내기(?=[\s·,.」)]|$)"),
    ("err", r"앞세우"),
    ("err", r"일이\s*되게\s*(?:하|만드|만들|함|했|해)"),
    ("err", r"앞과\s*뒤|뒤와\s*앞"),
    ("err", r"가려\s*(?:두|둠|둔|둘|뒀)"),
    ("err", r"맡음"),
    ("err", r"(?:돌아가는|도는)\s*설치"),
    ("err", r"(?:한도|쿼터|크레딧)[^\n]{0,6}먹(?!통|이|거리|성)"),
    ("err", r"(?:쿼터|한도|풀)[^\n]{0,12}(?:마(?:르|른|름)|말라|말랐)"),
    ("err", r"판단(?!력)[^\n]{0,10}해(?:내|낸|냄|낼|냈|냅)"),
    ("err", r"여는\s*모델"),
    ("err", r"스스로\s*낡"),
    ("err", r"(?:공수|자료|기록|데이터|값|내용|결과|로그)[^\n]{0,8}(?:붓|부어|부었|부으|부을)"),
    ("err", r"(?<![가-힣])진탐"),
    ("warn", r"(?:프로세스|파이썬|워커|배치|스크립트|세션|서버)[^\n]{0,6}죽(?!이|인|일|임|여|였)"),
    ("warn", r"[가-힣]{1,6}(?:는|을|던)\s*곳"),
    ("warn", r"(?:자동|프로그램|코드|버그|결함|취약점|가짜|오류|소스|패치|보안)\s?수리(?!비|점|공|센터)"),
    ("warn", r"앞에\s*세(?:우|웁|운|울|웠|워)"),
    ("warn", r"아무\s*데도"),
    ("warn", r"답이\s*안\s*나오"),
]
PERSONAL = [("warn", r"매일\s*밤"), ("warn", r"(?<![가-힣])늘(?=\s)(?!\s*(?:수|것|지|때|만큼|뿐|리|듯|거|까))")]

# Stock phrases, each with a name of its own.
STOCK = [
    ("beyond_mere", r"단순(?:한|히)\s?[가-힣]+(?:\s[가-힣]+){0,2}?(?:을|를)\s?넘어"),
    ("clear_verdict", r"(?:것은|점은|사실은)\s?(?:명확|분명|자명)(?:하다|합니다|해졌다|해졌습니다)(?=[.\s]|$)"),
    ("groundwork_metaphor", r"(?:발판|토대|초석)(?:을|를)\s?(?:마련|다지|다진|다졌|놓)|지평을\s?(?:열|여|연|넓)"),
    ("time_to_act", r"(?:야\s?할|나아갈|나설)\s(?:때|시점|순간)(?:입니다|이다)(?=[.!\s]|$)"),
    ("what_is_needed_is", r"(?:필요한|중요한)\s?것은\s[^.\n]{1,40}?[가-힣](?:이다|입니다)(?=[.\s]|$)"),
    ("the_reason_that", r"[가-힣]+(?:는|은|던)\s이유(?:다|입니다)(?=[.!\s]|$)"),
    ("empty_caveat", r"(?m)(?:^|[.!?]\s+)(?:그러나\s|다만\s|하지만\s)?(?:과제|한계|숙제|아쉬운\s?점)(?:도|는)\s?(?:남아\s?있|분명하)(?:다|습니다)\."),
    ("nobodys_analysis", r"[가-힣]+(?:다|라)는\s?(?:분석|평가|관측|전망)(?:이다|입니다)(?=[.\s]|$)"),
    ("in_regard_to", r"[가-힣]에\s?있어서\s"),
    ("in_relation_to", r"[가-힣](?:와|과)\s?관련(?:하여|해서)\s"),
    ("have_and_hold", r"(?:을|를)\s?가지고\s?있(?:다|습니다|는|으며|어)"),
    ("known_as", r"(?:라고|이라고)\s?(?:알려진|일컬어지는)\s"),
    ("inflated_meaning", r"시사하는\s?바가|주목할\s?만하|간과할\s?수\s?없|무시할\s?수\s?없|방점을\s?찍|의미가\s?적지\s?않|의미심장"),
    ("list_opener", r"크게\s(?:두|세|네|다섯)\s가지로\s나눌|다음과\s같은\s특징을\s가|다음과\s같이\s요약할\s수"),
    ("doubled_synonyms", r"중요하고\s핵심적인|새롭고\s혁신적인|지속적이고\s꾸준한|효과적이고\s효율적인"),
    ("paired_nouns", r"역할과\s기능|의미와\s가치"),
    ("double_hedge", r"가능성이\s?있을\s?수\s?있|보여질\s?수\s?있|(?:ㄹ|을|할)\s?수도\s?있을\s?것"),
    ("formal_noun", r"(?:다|라)는\s?점에\s?있(?:다|습니다)|주목할\s?점은"),
    ("aside_in_brackets", r"\((?:이는|즉|이것은)\s[^)]{3,}\)"),
    ("closing_formula", r"(?:라고|다고)\s?(?:할|볼)\s수\s있(?:다|습니다)|에\s다름\s아니|라\s하겠다"),
    ("inflated_words", r"전례\s?없는|가능성을\s?열어\s?(?:준|줍|주)"),
    ("the_point_lies_in", r"(?:핵심|관건|문제)은\s[^.\n]{2,40}?(?:데|점)에\s있(?:다|습니다)"),
    ("made_up_metaphor", r"청사진|적신호|경고등|신호탄|움켜쥐|움켜쥔|뿌리내리|뿌리내린|짓누르|짓눌"),
    ("felt_verdict", r"(?:진단|경고|분석|통계|현실|숫자|결과|지적|전망)(?:은|는|이|가)\s(?:서늘|아프|아픕|차갑|뜨겁|뜨거|묵직|섬뜩)"),
    ("talk_about_talk", r"(?:이\s?글|본\s?글|이번\s?글|이\s?문서|본\s?문서)에서는\s[^.\n]{0,40}(?:알아보겠습니다|살펴보겠습니다|다루겠습니다|소개하겠습니다)"),
    ("unnamed_source", r"(?:한|어느)\s(?:전문가|관계자|연구원|업계\s관계자|담당자)(?:(?:는|은)\s[^.\n]{0,60}?(?:말했|밝혔|전했|설명했|지적했|강조했|라고)|에\s따르면)"),
]

# Patterns that pile up: name, scope, least number, pattern.
REPEATS = [
    ("about", "para", 3, r"[가-힣A-Za-z0-9)」]에\s?대(?:해|하여|해서)\s"),
    ("through", "para", 3, r"[가-힣A-Za-z0-9)」](?:을|를)\s?통(?:해|하여|한)\s"),
    ("in_that", "doc", 3, r"(?:다|라)는\s?점에서\s"),
    ("based_on", "doc", 3, r"[가-힣]에\s?기반(?:하여|해|한|해서)\s|[가-힣](?:을|를)\s?바탕으로\s"),
    ("in_order_to", "para", 3, r"[가-힣](?:을|를)\s?위(?:해|하여|해서)\s"),
    ("being_done", "para", 3, r"[가-힣](?:되|(?<!가)지)고\s?있(?:다|습니다|으며|어|는|음)"),
    ("summing_up", "doc", 4, r"(?:결론적으로|요약하면|종합하면|정리하자면|이를\s통해|그러므로)\s"),
    ("from_to", "doc", 2, r"['‘“「][^'’”」]{1,15}['’”」]에서\s['‘“「][^'’”」]{1,15}['’”」](?:으로|로)"),
    ("adjectival_noun", "doc", 3, r"(?<![가-힣])(?!가급적|비교적)[가-힣]{2,4}적\s[가-힣]{2,}"),
    ("guess_ending", "doc", 3, r"(?:것으로|로)\s?(?:보인다|보입니다|판단된다|판단됩니다|여겨진다|여겨집니다)"),
    ("opening_conjunction", "para", 3, r"(?m)(?:^|[.!?]\s+)(?:또한|따라서|즉|나아가|아울러|게다가|더욱이|그리고)[,\s]"),
    ("this_is", "para", 3, r"(?m)(?:^|[.!?]\s+)(?:이는|이\s점에서|이\s관점에서|이\s말은)\s"),
    ("that_is", "doc", 3, r"(?:^|\s)즉[,\s]"),
    ("is_that", "doc", 3, r"다는\s?(?:것이다|것입니다|뜻이다|뜻입니다)"),
    ("ability", "doc", 3, r"[가-힣]{2,}\s능력"),
    ("quoted_stress", "doc", 5, r"['‘][가-힣 ]{1,12}['’]"),
]
STREAKS = [("can_do", 4, r"수\s있(?:다|습니다)[.]?$"), ("will_be", 3, r"것(?:이다|입니다)[.]?$")]
DUTY_END = r"(?:[가-힣]야\s?(?:한다|합니다)|할\s?필요가\s?있(?:다|습니다))[.]?\s*$"
GLOSS = r"[가-힣]+\(([A-Za-z][A-Za-z .\-]{1,30})\)"

FINDING = ["doc_key", "line_no", "kind", "severity", "match", "note"]


def _finding(df: DataFrame, kind: str, severity: Column | str, match: Column | str, note: Column | str = "") -> DataFrame:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select("doc_key", F.col("line_no").cast("int").alias("line_no"), F.lit(kind).alias("kind"), lit(severity).alias("severity"), (F.col(match) if isinstance(match, str) else match).alias("match"), lit(note).alias("note"))


def _findings(df: DataFrame, *each: tuple) -> DataFrame:
    """Several findings (whether, kind, severity, match, note) of the same rows, in one pass over them."""
    found = [F.struct(w.alias("found"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), m.alias("match"), n.alias("note")) for w, k, s, m, n in each]
    return df.select("doc_key", F.col("line_no").cast("int").alias("line_no"), F.inline(F.array(*found))).where("found").select(*FINDING)


def _hits(text: str, rule: Rule) -> Column:
    """Matches of a rule in a line.

    A veto sees the line from its start to the hit's end: the text is cut behind each hit, so that needs no function in Python.
    """
    none = F.array().cast("array<string>")
    every = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    if "\\1" in rule.pattern:  # the outer group would move the back-reference
        every = F.when(F.col(text).rlike(rule.pattern), F.array(strip(text))).otherwise(none)
    elif rule.unless:
        cut = F.split(F.regexp_replace(text, f"({rule.pattern})", "$1\u0001"), "\u0001")
        upto = F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda i: F.array_join(F.slice(cut, F.lit(1), i), ""))
        kept = F.filter(F.arrays_zip(upto.alias("upto"), every.alias("hit")), lambda h: ~h["upto"].rlike(rule.unless))
        every = F.when(F.col(text).rlike(rule.pattern), F.transform(kept, lambda h: h["hit"])).otherwise(none)
    return F.slice(every, 1, 1) if rule.first_only else every


def apply_rules(lines: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Hits of every rule in every line, in one pass."""
    found = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.note).alias("note"), _hits(text, r).alias("hits")) for r in rules]
    each = lines.select("doc_key", "line_no", F.inline(F.array(*found)))
    return each.select("doc_key", "line_no", "kind", "severity", F.explode("hits").alias("match"), "note").select(*FINDING)


def word_rules(personal: bool = False) -> list[Rule]:
    return [Rule("non_business_word", s, p) for s, p in [*NON_BUSINESS, *(PERSONAL if personal else [])]] + [Rule("stock_phrase", "warn", p, name) for name, p in STOCK]


def scannable(body: DataFrame) -> DataFrame:
    """Masked lines that rules of wording see: no quotes, examples or rows of contrast tables."""
    kept = structure.without_contrast(body).where(~F.col("text").rlike(r"^\s*>") & ~is_example("text"))
    return kept.withColumn("text", mask("text"))


def _in_hangul(body: DataFrame) -> DataFrame:
    """Lines that hold Hangul, where their tables have been told already; else all lines, as tables are told from their rows."""
    return body.where(F.col("text").rlike("[가-힣]")) if "contrast" in body.columns else body


def wording(body: DataFrame, personal: bool = False) -> DataFrame:
    """Findings of all line rules; a suspect seat gives way to a certain one on its line."""
    lines = scannable(_in_hangul(body)).where(F.col("text").rlike("[가-힣]"))
    found = apply_rules(lines, LINE_RULES + word_rules(personal))
    sure = F.max(F.col("kind") == "empty_seat").over(Window.partitionBy("doc_key", "line_no"))
    return found.withColumn("sure", sure).where("NOT (sure AND kind = 'empty_seat_suspect')").select(*FINDING)


def brand_findings(lines: DataFrame, brands: DataFrame) -> DataFrame:
    """Transliterated product names (wrong, canonical), every place of them."""
    found = patterns.find_terms(lines, brands, ["doc_key", "line_no"], term="wrong", overlapping=False).withColumnRenamed("term", "wrong")
    return _finding(found.join(brands.select("wrong", "canonical"), "wrong"), "brand_transliteration", "err", "wrong", F.col("canonical"))


def dictionary_hits(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_key, line_no, wrong, right, level, start, end) of dictionary entries, overlapping ones too.

    Scope ``head``: no Hangul or digit before; ``word``: no Hangul after either; ``any``: anywhere.  A hit is excepted where one of the entry's
    ``excepts``, placed so that its own first ``wrong`` falls on the hit, stands in the line.
    """
    at = ["doc_key", "line_no"]
    excepts = dictionary.select("wrong", F.explode("excepts").alias("term")).where(F.contains("term", F.col("wrong"))).distinct()
    found = patterns.find_terms(lines, dictionary.select(F.col("wrong").alias("term")).union(excepts.select("term")), at)
    head = ~F.col("before").rlike("[가-힣0-9]")
    in_scope = F.when(F.col("scope") == "any", True).when(F.col("scope") == "word", head & ~F.col("after").rlike("[가-힣]")).otherwise(head)
    hits = found.withColumnRenamed("term", "wrong").join(dictionary.select("wrong", "right", "scope", "level"), "wrong").where(in_scope)
    shields = found.join(excepts, "term").select(*at, "wrong", (F.col("start") + F.instr("term", F.col("wrong")) - 1).alias("start"))
    return hits.join(shields, [*at, "wrong", "start"], "left_anti").select(*at, "wrong", "right", "level", "start", "end")


def spelling_findings(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary entries (wrong, right, scope head, any or word, level, excepts) and the rules of finals, jamo and marks.

    Syllables that a dictionary hit takes are not reported again by the rules of finals.
    """
    hits = dictionary_hits(lines, dictionary)
    kind = F.when(F.col("level") == "warn", "spelling_suspect").otherwise("spelling")
    found = hits.select("doc_key", "line_no", kind.alias("kind"), F.col("level").alias("severity"), F.col("wrong").alias("match"), F.col("right").alias("note"))
    rest = lines.where(F.col("text").rlike("[가-힣ㄱ-ㅣ]"))

    def by_final(pattern: str, test, kind: str, note, width: int = 0) -> Column:
        """Hits whose first character passes the test; ``width``: so many of their characters must not be taken."""
        kept = F.filter(placed("text", pattern), lambda h: test(F.substring(h["match"], 1, 1), h["match"]))
        return F.struct(F.lit(kind).alias("kind"), F.lit(width).alias("width"), F.transform(kept, lambda h: F.struct(h["match"].alias("match"), h["start"].alias("start"), note(h["match"]).alias("note"))).alias("hits"))

    says = lambda s: lambda h: F.lit(s)
    ends = r"(?=요|[^가-힣]|$)"
    rules = [
        by_final(rf"[가-힣](?:께|껄){ends}", lambda c, h: (final_consonant(c) == 8) & ~c.isin(*"들월일말달설"), "spelling", says("plain consonant after ㄹ"), width=1),
        by_final(r"[가-힣]꺼(?=야|요|예요|에요|다|라|니|든|면|[^가-힣]|$)", lambda c, h: (final_consonant(c) == 8) & ~c.isin(*"들월일말달설불를"), "spelling", says("거"), width=1),
        by_final(r"[가-힣]런지", lambda c, h: (final_consonant(c) == 8) & (c != "벨"), "spelling", says("-ㄹ는지"), width=1),
        by_final(r"[가-힣]구요(?=[^가-힣]|$)", lambda c, h: final_consonant(c) == 20, "spelling", says("-고요"), width=1),
        by_final(r"[가-힣]율", lambda c, h: ~final_consonant(c).isin(0, 4), "spelling_suspect", says("률"), width=2),
        by_final(r"[가-힣]률", lambda c, h: final_consonant(c).isin(0, 4), "spelling_suspect", says("율"), width=2),
        by_final(r"(?<=[가-힣])[가-힣]수 (?=있|없)|(?<![가-힣])[가-힣&&[^실별홀말일술필철]]수 (?=있|없)", lambda c, h: (final_consonant(c) == 8) & (c != "일"), "spelling", says("space before 수"), width=1),
        by_final(r"(?<=[가-힣])일수 (?=있|없)", lambda c, h: F.lit(True), "spelling_suspect", says("space before 수, unless days are meant"), width=1),
        by_final(r"[가-힣][ㄱ-ㅣ]+(?![ㄱ-ㅣ])", lambda c, h: ~h.rlike(r"^[가-힣](?:[ㅋㅎㅠㅜ]+|([ㄱ-ㅣ])\1+)$"), "spelling", says("stray jamo")),
        by_final(r"(?<![가-힣ㄱ-ㅣ])[ㄱ-ㅣ]+[가-힣]", lambda c, h: ~h.rlike(r"^(?:[ㅋㅎㅠㅜ]+|([ㄱ-ㅣ])\1+|[ㄴㄹㅁㅂㅅ])[가-힣]$|^[ㄱ-ㅣ]자$"), "spelling_suspect", says("stray jamo")),
        by_final("\\S[\u200b\u200c\u200d\u2060\ufeff]", lambda c, h: F.lit(True), "spelling", says("invisible character")),
        by_final("(?<=\\s)[\u200b\u200c\u200d\u2060\ufeff]", lambda c, h: F.lit(True), "spelling_suspect", says("invisible character")),
        by_final(r"[가-힣A-Za-z0-9]\.[!?]", lambda c, h: F.lit(True), "spelling_suspect", says("one mark")),
    ]
    each = rest.select("doc_key", "line_no", F.inline(F.array(*rules))).select("doc_key", "line_no", "kind", "width", F.inline("hits"))
    free = intervals.without_overlaps(each, hits, ["doc_key", "line_no"], end=F.col("start") + F.col("width"))
    more = free.select("doc_key", "line_no", "kind", F.when(F.col("kind") == "spelling", "err").otherwise("warn").alias("severity"), "match", "note")
    return found.union(more).select(*FINDING)


def skipped_capabilities(documents: DataFrame) -> DataFrame:
    """(doc_key, capability, status): what is judged by lists because no analyser is installed, where it matters."""
    needs = {"spacing": r"[가-힣](?:것|거|겁|게|걸|건|줄|때)|[가-힣] (?:하|한|할|함|해|했|합|되|된|될|됨|돼|됐|됩)", "pronouns": "우리|이들|저들|여기|거기|이것|그것", "time_noun": r"는\s*때"}
    each = F.array(*[F.struct(F.lit(k).alias("capability"), F.col("raw").rlike(p).alias("applies")) for k, p in needs.items()])
    return documents.select("doc_key", F.inline(each)).where("applies").select("doc_key", "capability", F.when(F.col("capability") == "spacing", "skipped").otherwise("fallback").alias("status"))


def value_findings(body: DataFrame, relaxed: bool = False) -> DataFrame:
    """Sentence endings and cut-offs in value slots, plain speech among them."""
    slots = structure.value_slots(structure.wrapped(body), ("wrapped",)).where("NOT text rlike '^[-: ]*$'").where(F.col("text").rlike("[가-힣]"))  # no rule of values goes without
    cut = slots.withColumn("f", fragment("text"))
    certain = F.col("f.err").isNotNull() & ~F.col("wrapped")
    suspect = ~certain & (F.col("f.err").isNotNull() | F.col("f.warn").isNotNull())
    begin, why, none = F.substring("text", 1, 60), F.coalesce("f.err", "f.warn"), F.lit("")
    cut = _findings(cut, (certain, "cut_ending", "err", begin, why), (suspect, "cut_ending_suspect", "warn", begin, why), (F.trim("text").rlike(ONLY_DEICTIC), "deictic_check", "warn", F.col("text"), none))
    said = slots.select("doc_key", "line_no", F.explode(sentences("text")).alias("s")).where(is_narrative("s"))
    narrative = ("unlabeled_statement", "warn") if relaxed else ("narrative_ending", "err")
    return cut.union(_findings(said, (F.lit(True), *narrative, F.substring("s", 1, 60), none), (is_plain_speech("s"), "plain_speech", "err", F.substring("s", 1, 60), none)))


def heading_findings(body: DataFrame) -> DataFrame:
    """Headings that are sentences, cut off, or only about reading the document; H1 without a lede, and the lede's form."""
    heads = structure.headings(body).withColumn("f", fragment("title"))
    title, none = F.col("title"), F.lit("")
    told = _findings(heads, (is_narrative("title"), "heading_narrative", "err", title, none), *_forms("title", "heading"), (title.rlike(META_HEADING), "unscannable_label", "warn", title, none))
    ledes = structure.ledes(body)
    missing = _finding(ledes.where("lede IS NULL").withColumn("line_no", F.col("h1_line")), "lede_missing", "err", F.lit(""))
    at = ledes.where("lede IS NOT NULL").withColumn("line_no", F.col("lede_line"))
    return told.union(missing).union(_lede_findings(at))


def _forms(shown: str, what: str) -> list[tuple]:
    """Of rows (…, f) those whose text is cut off or a question as errors, those that may be as warnings."""
    certain = F.col("f.err").isNotNull() | F.coalesce(F.col("f.warn") == "question label", F.lit(False))
    return [(certain, f"{what}_not_nominal", "err", F.col(shown), F.coalesce("f.err", "f.warn")), (~certain & F.col("f.warn").isNotNull(), f"{what}_form_check", "warn", F.col(shown), F.col("f.warn"))]


def _form_findings(rows: DataFrame, shown: str, what: str) -> DataFrame:
    return _findings(rows, *_forms(shown, what))


def _lede_findings(ledes: DataFrame) -> DataFrame:
    """The form of ledes (doc_key, line_no, lede): each value of it, and its sentences."""
    told = ledes.select("doc_key", "line_no", F.explode(F.split(strip_tags("lede"), r"(?<=\.)\s+")).alias("s")).withColumn("s", strip("s")).where(is_narrative("s"))
    bare = F.replace(drop_tail(strip_tags("lede")), F.lit("**"), F.lit(""))
    values = ledes.select("doc_key", "line_no", F.explode(structure.label_values(bare)).alias("v")).where(~all_quoted("v")).withColumn("f", fragment(drop_tail("v")))
    return _finding(told, "lede_narrative", "err", F.substring("s", 1, 60)).union(_form_findings(values, "v", "lede"))


def label_findings(body: DataFrame) -> DataFrame:
    """Labels that say nothing, and lists whose blocks are labelled differently."""
    label = r"^\s*(?:[-*]\s+|\d+[.)]\s+)?\*\*(.+?)\*\*\s*[:：]"
    named = body.where(F.col("text").rlike(label)).withColumn("label", F.regexp_extract("text", label, 1))
    empty = _finding(named.where(F.col("label").isin(BAD_LABELS)), "unscannable_label", "warn", "label")
    heads = structure.table_cells(body).where("header").where(F.col("text").isin(BAD_LABELS))
    empty = empty.union(_finding(heads, "unscannable_label", "warn", "text"))
    blocks = structure.list_blocks(body).where(F.col("text").rlike(label)).withColumn("label", F.regexp_extract("text", label, 1))
    return empty.union(_uneven(blocks, 2))


def _uneven(blocks: DataFrame, least: int) -> DataFrame:
    """Documents with three or more labelled blocks (doc_key, block, label) and more labels used once than half the blocks."""
    sets = blocks.groupBy("doc_key", "block").agg(F.collect_list("label").alias("labels")).where(F.size("labels") >= least)
    n_sets = sets.groupBy("doc_key").agg(F.count("*").alias("n_sets"), F.min("block").alias("line_no")).where("n_sets >= 3")
    single = sets.select("doc_key", F.explode("labels").alias("label")).groupBy("doc_key", "label").count().where("count = 1").groupBy("doc_key").agg(F.count("*").alias("n_single"), F.min("label").alias("label"))
    return _finding(n_sets.join(single, "doc_key").where("n_single > n_sets / 2"), "block_label_mismatch", "warn", "label")


# What names a quotation's source: a bracketed date, or a bracketed word for evidence.
SOURCED = r"`\[[^`]*\]`|[\[(][^\])]{0,20}\d{1,2}/\d{1,2}[^\])]{0,20}[\])]|[\[(](?:사내|근거|출처)[^\])]*[\])]"


def quote_findings(body: DataFrame) -> DataFrame:
    """Commentary set as a quotation: a sentence in a block quote without a source."""
    rows = structure.quote_blocks(body).withColumn("said", F.regexp_replace("text", r"^\s*>+\s*", ""))
    rows = rows.withColumn("sourced", F.max(F.col("text").rlike(SOURCED)).over(Window.partitionBy("doc_key", "block")))
    return _finding(rows.where(~F.col("sourced") & is_narrative("said")), "commentary_as_quote", "warn", F.substring("said", 1, 60))


def section_findings(body: DataFrame) -> DataFrame:
    """Sections named by number: § references to this document, and bare numbers that a heading has."""
    return _section_hits(body, ~F.col("text").rlike("^#"), structure.heading_numbers(body))


def _section_hits(body: DataFrame, is_body: Column, numbers: DataFrame) -> DataFrame:
    clean = lambda rows: rows.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"`[^`]*`", " "), r"[「『][^」』]*[」』]\s*\(?(?=\d|§)", "」"))
    marked = clean(body.where(F.col("text").contains("§"))).withColumn("hit", F.explode(F.regexp_extract_all("text", F.lit(rf"({STANDARD_BEFORE}{SECTION_REF}|{SECTION_REF})"), F.lit(1)))).where(F.col("hit").startswith("§"))
    by_document = numbers.groupBy("doc_key").agg(F.map_from_entries(F.collect_list(F.struct("number", "title"))).alias("titles"))
    bare = clean(body.where((F.col("text").contains("절") | F.col("text").rlike(r"\(\d")) & is_body)).select("doc_key", "line_no", F.explode(F.regexp_extract_all("text", F.lit(f"({BARE_SECTION})"), F.lit(1))).alias("hit"))
    bare = bare.withColumn("number", F.regexp_extract("hit", r"\d{1,2}(?:[-.]\d{1,2})*", 0)).join(by_document, "doc_key")
    bare = bare.withColumn("title", F.try_element_at("titles", F.col("number"))).where("title IS NOT NULL")
    return _finding(marked, "section_by_number", "err", "hit").union(_finding(bare, "section_by_number", "err", "hit", F.col("title")))


def middot_findings(body: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Spaced middots on lines that the ledger of old lines (doc_key, line_hash) does not have."""
    from prosewright.functions.text import short_sha1

    masked = F.regexp_replace(F.regexp_replace("text", r"`[^`]*`", "□"), r"[「『][^」』]*[」』]", "□")
    hits = body.where(F.col("text").contains("·") & masked.rlike(r"[가-힣]\s+·\s*[가-힣]|[가-힣]\s*·\s+[가-힣]")).withColumn("line_hash", short_sha1("text"))
    if ledger is not None:
        hits = hits.join(ledger, ["doc_key", "line_hash"], "left_anti")
    return _finding(hits, "spaced_middot", "err", F.substring("text", 1, 60))


def prose_in_code(lines: DataFrame) -> DataFrame:
    """Fences tagged as text with three sentences or more that are not introduced as an example; lines are parsed ones."""
    w = structure.by_line()
    edge = lines.withColumn("start", F.col("fenced") & ~F.coalesce(F.lag("fenced").over(w), F.lit(False))).withColumn("before", F.lag("text").over(w))
    marked = edge.withColumn("fence", F.last(F.when(F.col("start"), F.struct("line_no", "text", "before")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("fenced AND NOT start")
    told = F.trim("text").rlike(r"[가-힣](?:다|요|음|함)[.!?]?$")
    by = marked.where(F.col("fence.text").rlike(r"^\s*(?:`{3,}|~{3,})\s*(?:text|txt|md|markdown|plain)\s*$") & ~F.coalesce(F.col("fence.before").rlike("예시|보기|예:"), F.lit(False)))
    by = by.groupBy("doc_key", F.col("fence.line_no").alias("line_no")).agg(F.count_if(told).alias("n")).where("n >= 3")
    return _finding(by, "prose_in_code_block", "warn", F.col("n").cast("string"))


def not_but_findings(body: DataFrame, least: int = 2, density: float = 3.0) -> DataFrame:
    """Not this but that: all hits of documents with several of them and at least ``density`` for 10,000 Hangul characters."""
    lines = scannable(_in_hangul(body))
    hits = lines.select("doc_key", "line_no", F.explode(F.regexp_extract_all("text", F.lit(f"({NOT_BUT})"), F.lit(1))).alias("hit"))
    chars = lines.groupBy("doc_key").agg(F.sum(hangul_count("text")).alias("chars"))
    dense = hits.groupBy("doc_key").agg(F.count("*").alias("n")).join(chars, "doc_key").where((F.col("n") >= least) & (F.col("n") * 10000 >= density * F.col("chars"))).select("doc_key")
    return _finding(hits.join(dense, "doc_key"), "not_but_pileup", "warn", "hit")


def repetition(paras: DataFrame) -> DataFrame:
    """Patterns that pile up in paragraphs (doc_key, first_line, text) or over a document, streaks, duty endings, repeated glosses."""
    paras = paras.select("doc_key", F.col("first_line").alias("line_no"), mask("text").alias("text"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("scope"), F.lit(k).alias("need"), F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)).alias("hits")) for n, s, k, p in REPEATS])
    counted = paras.select("doc_key", "line_no", F.inline(each)).where(F.size("hits") > 0).withColumn("n", F.size("hits"))
    para = counted.where("scope = 'para' AND n >= need").select("doc_key", "line_no", "name", "n", F.element_at("hits", 1).alias("hit"))
    doc = counted.where("scope = 'doc'").groupBy("doc_key", "name", "need").agg(F.sum("n").alias("n"), F.min(F.struct("line_no", F.element_at("hits", 1).alias("hit"))).alias("first"))
    doc = doc.where("n >= need").select("doc_key", "first.line_no", "name", "n", "first.hit")
    sents = paras.select("doc_key", "line_no", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("i", "s"))
    streaks = []
    for name, need, pattern in STREAKS:
        w = Window.partitionBy("doc_key", "line_no").orderBy("i")
        runs = sents.where(strip("s").rlike(pattern)).withColumn("run", F.col("i") - F.row_number().over(w)).groupBy("doc_key", "line_no", "run").agg(F.count("*").alias("n"), F.max_by("s", "i").alias("hit"))
        best = runs.groupBy("doc_key", "line_no").agg(F.max(F.struct("n", "hit")).alias("b")).where(F.col("b.n") >= need)
        streaks.append(best.select("doc_key", "line_no", F.lit(name).alias("name"), F.col("b.n").alias("n"), F.col("b.hit").alias("hit")))
    duty = paras.where(strip("text").rlike(DUTY_END)).groupBy("doc_key").agg(F.array_sort(F.collect_list("line_no")).alias("at")).where(F.size("at") >= 2)
    duty = duty.select("doc_key", F.element_at("at", 2).alias("line_no"), F.lit("duty_ending").alias("name"), F.size("at").alias("n"), F.lit("").alias("hit"))
    gloss = paras.select("doc_key", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(GLOSS), F.lit(1))).alias("i", "term"))
    again = gloss.withColumn("n", F.row_number().over(Window.partitionBy("doc_key", F.lower(F.trim("term"))).orderBy("line_no", "i"))).where("n > 1").select("doc_key", "line_no", F.lit("repeated_gloss").alias("name"), F.lit(2).alias("n"), F.col("term").alias("hit"))
    out = para.union(doc)
    for more in (*streaks, duty, again):
        out = out.union(more.select("doc_key", "line_no", "name", F.col("n").cast("int").alias("n"), "hit"))
    return _finding(out, "repeated_pattern", "warn", "hit", F.concat_ws(" x", "name", F.col("n").cast("string")))


def register_of(body: DataFrame) -> DataFrame:
    """(doc_key, line_no, s, plain): sentences with their speech level."""
    body = body.where(F.col("text").contains("다") | F.trim("text").rlike(r"^\|.*\|"))  # table rows stay, as they make up blocks
    said = structure.value_slots(body).select("doc_key", "line_no", F.explode(sentences("text")).alias("s"))
    flowing = body.where(~F.trim("text").rlike(r"^(?:[-*+>|#]|\d+[.)]\s)")).select("doc_key", "line_no", F.explode(sentences("text")).alias("s"))
    return said.union(flowing).where(is_narrative("s")).withColumn("plain", is_plain_speech("s"))


def register_findings(said: DataFrame, least: int = 12, share: float = 0.25, ratio: int = 2, personal: bool = False) -> DataFrame:
    """Minority sentences of documents that mix speech levels.

    With a personal profile: at least ``least`` sentences and a minority under ``share``, as warnings.  Without: strays from a
    majority of at least ``ratio`` times the minority, as errors, once a line; undecided mixes give one warning.
    """
    own = Window.partitionBy("doc_key")
    both = said.where("doc_key IS NOT NULL").withColumns({"polite": F.count_if(~F.col("plain")).over(own), "plain_n": F.count_if("plain").over(own)}).where("polite > 0 AND plain_n > 0")
    both = both.withColumn("minor", F.least("polite", "plain_n")).withColumn("in_minor", F.col("plain") != (F.col("polite") < F.col("plain_n")))
    if personal:
        kept = both.where((F.col("polite") + F.col("plain_n") >= least) & (F.col("minor") < share * (F.col("polite") + F.col("plain_n"))) & F.col("in_minor"))
        return _finding(kept, "register_mix", "warn", F.substring("s", 1, 60))
    clear = F.greatest("polite", "plain_n") >= ratio * F.col("minor")
    strays = both.where(clear & F.col("in_minor")).groupBy("doc_key", "line_no").agg(F.min("s").alias("s"))
    open_ = both.where(~clear).groupBy("doc_key").agg(F.min("line_no").alias("line_no"))
    return _finding(strays, "register_mix", "err", F.substring("s", 1, 60)).union(_finding(open_, "register_mix", "warn", F.lit("")))


def markdown_findings(
    documents: DataFrame, dictionary: DataFrame | None = None, brands: DataFrame | None = None, ledger: DataFrame | None = None, personal: bool = False, parsed: DataFrame | None = None
) -> DataFrame:
    """All findings of Markdown documents (doc_key, raw) before the finding algebra.

    ``parsed`` are the documents' lines dealt by document (``structure.dealt_lines``), if at hand and persisted by the caller.
    Every family works within a document, so the lines are shuffled once and the families are narrow.
    """
    if parsed is None:
        parsed = structure.dealt_lines(documents)
    body = structure.merged_body(parsed)
    lines = scannable(body)
    paras = parsed.where("para IS NOT NULL").select("doc_key", F.col("line_no").alias("first_line"), F.col("para").alias("text")) if "para" in parsed.columns else structure.paragraphs(parsed.where("NOT fenced").drop("fenced"))
    parts = [
        value_findings(body), heading_findings(body), label_findings(body), quote_findings(body), section_findings(body), middot_findings(body, ledger), wording(body, personal), not_but_findings(body),
        repetition(paras), register_findings(register_of(body), personal=personal), prose_in_code(parsed.select("doc_key", "line_no", "text", "fenced")),
    ]
    if dictionary is not None:
        parts.append(spelling_findings(lines, dictionary))
    if brands is not None:
        parts.append(brand_findings(lines, brands))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.select(*FINDING))
    return out


def html_structure_findings(pages: DataFrame) -> list[DataFrame]:
    """What Markdown's structure rules say, over elements: ledes, labelled blocks, block quotes, sections named by number."""
    raw = structure.clean_html("raw")
    nowhere = F.lit(None).cast("int").alias("line_no")
    every = lambda p: F.regexp_extract_all(raw, F.lit(p), F.lit(1))
    named = every(r'(?is)<p\b[^>]*class="lede"[^>]*>(.*?)</p>')
    first = F.regexp_extract(F.regexp_extract(raw, r"(?is)</h1>(.*)$", 1), r"(?is)<p\b[^>]*>(.*?)</p>", 1)
    ledes = pages.select("doc_key", nowhere, F.when(F.size(named) > 0, named).when(raw.rlike("(?i)<h1"), F.array(first)).alias("ledes")).where("ledes IS NOT NULL")
    ledes = ledes.select("doc_key", "line_no", F.explode("ledes").alias("lede"))
    missing = _finding(ledes.where(strip_tags("lede") == ""), "lede_missing", "err", F.lit(""))
    labels = elements.elements(pages, ("article", "section", "dt")).where("tag = 'dt' AND owner IS NOT NULL").select("doc_key", F.col("owner").alias("block"), strip_tags("own").alias("label"))
    # a quotation's own text; one inside it is a quotation of its own, and what stands before and behind that stays apart
    quotes = elements.elements(pages, ("blockquote",)).select("doc_key", nowhere, F.col("own").alias("q")).where(~squeeze(strip_tags("q")).rlike(SOURCED))
    parts = F.filter(F.transform(F.split("q", "\u0001"), lambda q: squeeze(strip_tags(q))), lambda q: q != "")
    said = quotes.select("doc_key", "line_no", F.explode(F.flatten(F.transform(parts, lambda q: F.split(q, r"(?<=다\.)\s+")))).alias("s")).withColumn("s", strip(F.replace("s", F.lit("**"), F.lit("")))).where(is_narrative("s"))
    heads = pages.select("doc_key", F.posexplode(structure.html_headings("raw")).alias("line_no", "h")).select("doc_key", "line_no", "h.title")
    whole = pages.select("doc_key", nowhere, strip_tags(F.regexp_replace(raw, r"(?is)<h([1-6])\b[^>]*>.*?</h\1>", "\n")).alias("text"), F.lit(True).alias("is_body"))
    titles = heads.select("doc_key", F.lit(None).cast("int").alias("line_no"), F.col("title").alias("text"), F.lit(False).alias("is_body"))
    sections = _section_hits(whole.union(titles), F.col("is_body"), structure.numbered_titles(heads))
    return [missing, _lede_findings(ledes.where(strip_tags("lede") != "")), _uneven(labels, 1), _finding(said, "commentary_as_quote", "warn", F.substring("s", 1, 60)), sections]


def html_findings(pages: DataFrame, dictionary: DataFrame | None = None, brands: DataFrame | None = None, ledger: DataFrame | None = None, personal: bool = False) -> DataFrame:
    """Findings of HTML documents (doc_key, raw): the same rules over visible lines, values, paragraphs and headings."""
    visible = structure.visible_html_lines(pages)
    lines = visible.where(~is_example("text")).withColumn("text", mask("text"))
    nowhere = F.lit(None).cast("int").alias("line_no")
    slots = structure.html_slots(pages).select("doc_key", nowhere, "text", fragment("text").alias("f"))
    said = slots.select("doc_key", "line_no", F.explode(sentences("text")).alias("s"))
    told = elements.paragraphs(pages).select("doc_key", nowhere, F.explode(sentences("text")).alias("s"))
    heads = pages.select("doc_key", nowhere, F.explode(structure.html_headings("raw")).alias("h")).select("doc_key", "line_no", "h.title").withColumn("f", fragment("title"))
    labels = pages.select("doc_key", nowhere, F.explode(F.regexp_extract_all(structure.clean_html("raw"), F.lit(r'(?is)(?:<(?:dt|th)\b[^>]*>|class="k"[^>]*>)(.*?)</'), F.lit(1))).alias("label")).withColumn("label", structure.strip_tags("label"))
    both = said.union(told).where(is_narrative("s")).withColumn("plain", is_plain_speech("s"))
    parts = [
        apply_rules(lines, LINE_RULES + word_rules(personal)), _finding(said.where(is_narrative("s")), "narrative_ending", "err", F.substring("s", 1, 60)),
        _finding(told.where(is_narrative("s")), "narrative_paragraph", "err", F.substring("s", 1, 60)), _finding(both.where("plain"), "plain_speech", "err", F.substring("s", 1, 60)),
        _finding(slots.where("f.err IS NOT NULL"), "cut_ending", "err", "text", F.col("f.err")), _finding(slots.where("f.err IS NULL AND f.warn IS NOT NULL"), "cut_ending_suspect", "warn", "text", F.col("f.warn")),
        _finding(heads.where(is_narrative("title")), "heading_narrative", "err", "title"), _form_findings(heads.where(~all_quoted("title")), "title", "heading"),
        *html_structure_findings(pages),
        _finding(heads.where(F.col("title").rlike(META_HEADING)), "unscannable_label", "warn", "title"), _finding(labels.where(F.col("label").isin(BAD_LABELS)), "unscannable_label", "warn", "label"),
        not_but_findings(visible), repetition(visible.select("doc_key", F.col("line_no").alias("first_line"), "text")), middot_findings(visible, ledger), register_findings(both, personal=personal),
    ]
    if dictionary is not None:
        parts.append(spelling_findings(lines, dictionary))
    if brands is not None:
        parts.append(brand_findings(lines, brands))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.select(*FINDING))
    return out
