"""The specimens that are planted into the given documents, and the SQL of what the wording check must say of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.operators import planting, rules, structure
from prosewright.operators.planting import Specimen


def _uneven(labels: list[str]) -> str:
    return "\n\n".join(f"- **이름**: 값\n- **{label}**: 값" for label in labels)


def _own(family: str, kind: str, pairs: list[tuple[str, str]]) -> list[Specimen]:
    return [Specimen(family, kind, bad, good) for bad, good in pairs]


def _noted(kind: str, pairs: list[tuple[str, str, str]]) -> list[Specimen]:
    return [Specimen("piled", kind, bad, good, note) for note, bad, good in pairs]


#: One family for what a line's words show, one for the form of values, headings and blocks, one for what piles up.
SPECIMENS: list[Specimen] = [
    *_own("words", "empty_seat", [("오류가 터지는 자리", "빈 자리")]),
    *_own("words", "empty_seat_suspect", [("사람이 머무는 자리", "같은 자리")]),
    *_own("words", "evaluative_modifier", [("강력한 도구", "작은 도구"), ("참가자 30%에 불과", "참가자 30%")]),
    *_own("words", "vague_reference", [("우리 부서", "아이들은 여럿")]),
    *_own("words", "deictic_check", [("여기에 적음", "여기저기")]),
    *_own("words", "non_business_word", [("기록을 걷음", "기록을 수집"), ("새 기능을 붙이는 일", "사진을 붙이는 일"), ("서버 앞과 뒤", "서버 앞")]),
    *_own("words", "stock_phrase", [("단순한 도구를 넘어 발전", "도구의 발전"), ("토대를 마련함", "토대 공사"), ("전례 없는 성과", "작년의 성과"), ("역할과 기능", "역할")]),
    *_own("words", "double_passive", [("그렇게 보여지다", "그렇게 보이다")]),
    *_own("words", "double_particle", [("학교에서의 생활", "경로의 선택")]),
    *_own("words", "calque_pronoun", [("그녀의 말", "이름의 말")]),
    *_own("words", "misread_word", [("세 종이 있음", "세 종류")]),
    *_own("words", "unfamiliar_term", [("정본 보관", "정본화 작업")]),
    *_own("words", "wrong_term_session", [("지난 회기 실적", "국회 회기 중")]),
    *_own("words", "trailing_paren_name", [("그렇게 말했다 (Acme)", "그렇게 말했다 (1)")]),
    *_own("words", "invented_noun_phrase", [("손이 닿는 값", "받는 값")]),
    *_own("words", "head_echo", [("- 완료 — 모든 작업 완료함", "- 완료 — 모든 작업 종료")]),
    *_own("words", "spelling", [("몇일 뒤", "며칠 뒤"), ("먼저 할께요", "먼저 할게요"), ("말을 했구요", "말을 했고요"), ("지금 할수 있음", "지금 할 수 있음")]),
    *_own("words", "spelling_suspect", [("올해 성공율", "올해 성공률"), ("안되 보임", "안 돼 보임"), ("작업 끝.!", "작업 끝.")]),
    *_own("words", "brand_transliteration", [("스파크 작업", "Spark 작업")]),
    *_own("words", "spaced_middot", [("가 · 나", "가·나")]),
    *_own("form", "narrative_ending", [("- 값이 올랐다", "- 값 상승")]),
    *_own("form", "plain_speech", [("- 값이 내렸다", "- 값 하락")]),
    *_own("form", "cut_ending", [("- 담당자에게", "- 담당자")]),
    *_own("form", "cut_ending_suspect", [("- 이번 달까지", "- 이번 달")]),
    *_own("form", "heading_narrative", [("## 값이 올랐다", "## 값 상승")]),
    *_own("form", "heading_not_nominal", [("## 어떻게 볼까", "## 보는 방법")]),
    *_own("form", "heading_form_check", [("## 이번 달까지", "## 이번 달")]),
    *_own("form", "lede_missing", [("# 검토 결과" + "\n" * 7, "# 검토 결과\n\n하반기 검토 범위" + "\n" * 5)]),
    *_own("form", "lede_narrative", [("# 검토 결과\n\n검사팀이 확인했다.", "# 검토 결과\n\n하반기 검토 범위")]),
    *_own("form", "lede_not_nominal", [("# 검토 결과\n\n담당자에게", "# 검토 결과\n\n하반기 검토 범위")]),
    *_own("form", "lede_form_check", [("# 검토 결과\n\n이번 달까지", "# 검토 결과\n\n하반기 검토 범위")]),
    *_own("form", "unscannable_label", [("## 읽는 순서", "## 설치 순서"), ("- **내용**: 값", "- **기한**: 값"), ("| 비고 | 이름 |\n|--|--|\n| a | b |", "| 기한 | 이름 |\n|--|--|\n| a | b |")]),
    *_own("form", "block_label_mismatch", [(_uneven(["항목1", "항목2", "항목3", "항목4"]), _uneven(["기한"] * 4))]),
    *_own("form", "commentary_as_quote", [("\n" * 6 + "> 값이 내렸다", "\n" * 6 + "> 값이 내렸다 (출처 표)")]),  # the first six lines are a document's head
    *_own("form", "section_by_number", [("자세한 것은 §3 참고", "자세한 것은 결과 참고"), ("## 2-1. 이름\n\n(2-1) 참고", "## 2-1. 이름\n\n(9-9) 참고")]),
    *_own("form", "prose_in_code_block", [("안내\n```text\n하나다.\n둘이다.\n셋이다.\n```", "예시\n```text\n하나다.\n둘이다.\n셋이다.\n```")]),
    *_own("piled", "register_mix", [("\n".join(["- 값이 오릅니다"] * 4 + ["- 값이 내렸다"]), "\n".join(["- 값이 오릅니다"] * 4 + ["- 값이 내립니다"]))]),
    *_own("piled", "not_but_pileup", [("사람이 아니라 기계다. 말이 아니라 글이다.", "사람이 아니라 기계다. 말도 글도 있다.")]),
    *_noted("repeated_pattern", [
        ("about", "가에 대해 말. 나에 대해 말. 다에 대해 말.", "가에 대해 말. 나에 대해 말. 다의 말."),
        ("through", "말을 통해 앎. 글을 통해 앎. 일을 통해 앎.", "말을 통해 앎. 글을 통해 앎. 일로 앎."),
        ("in_that", "빠르다는 점에서 앞섬. 싸다는 점에서 앞섬. 쉽다는 점에서 앞섬.", "빠르다는 점에서 앞섬. 싸다는 점에서 앞섬. 쉬워서 앞섬."),
        ("based_on", "값에 기반해 정함. 글에 기반해 정함. 말을 바탕으로 정함.", "값에 기반해 정함. 글에 기반해 정함. 말로 정함."),
        ("in_order_to", "일을 위해 함. 말을 위해 함. 글을 위해 함.", "일을 위해 함. 말을 위해 함. 글로 함."),
        ("being_done", "일이 진행되고 있음. 값이 수집되고 있음. 글이 정리되고 있음.", "일이 진행되고 있음. 값이 수집되고 있음. 글이 정리됨."),
        ("summing_up", "결론적으로 끝. 요약하면 끝. 종합하면 끝. 정리하자면 끝.", "결론적으로 끝. 요약하면 끝. 종합하면 끝. 모두 끝."),
        ("from_to", "'가'에서 '나'로 감. '다'에서 '라'로 감.", "'가'에서 '나'로 감. '다'에서 멈춤."),
        ("adjectival_noun", "기술적 문제. 정치적 문제. 경제적 문제.", "기술적 문제. 정치적 문제. 돈 문제."),
        ("guess_ending", "좋은 것으로 보인다. 나쁜 것으로 보인다. 같은 것으로 판단된다.", "좋은 것으로 보인다. 나쁜 것으로 보인다. 모두 같다."),
        ("opening_conjunction", "또한, 말. 따라서, 글. 나아가, 일.", "또한, 말. 따라서, 글. 그밖의 일."),
        ("this_is", "이는 말. 이는 글. 이는 일.", "이는 말. 이는 글. 그밖의 일."),
        ("that_is", "말 즉, 글. 글 즉, 일. 일 즉, 값.", "말 즉, 글. 글 즉, 일. 일과 값."),
        ("is_that", "좋다는 것이다. 나쁘다는 것이다. 같다는 뜻이다.", "좋다는 것이다. 나쁘다는 것이다. 모두 같다."),
        ("ability", "기술 능력. 언어 능력. 계산 능력.", "기술 능력. 언어 능력. 계산 속도."),
        ("quoted_stress", "'가' '나' '다' '라' '마'", "'가' '나' '다' '라' 마"),
        ("can_do", "할 수 있다. 갈 수 있다. 볼 수 있다. 쓸 수 있다.", "할 수 있다. 갈 수 있다. 볼 수 있다. 모두 쓴다."),
        ("will_be", "할 것이다. 갈 것이다. 볼 것이다.", "할 것이다. 갈 것이다. 모두 본다."),
        ("duty_ending", "다시 해야 한다\n\n다시 봐야 한다", "다시 해야 한다\n\n다시 본다"),
        ("repeated_gloss", "에이피아이(API) 다시 인터페이스(api)", "에이피아이(API) 다시 인터페이스"),
    ]),
]

# Entries of a spelling list and a brand list: wrong, right, scope, level, excepts, why; wrong, canonical.
SPELLING = [("몇일", "며칠", "head", "err", ["몇일자"], ""), ("안되", "안 되", "word", "warn", [], "")]
BRANDS = [("스파크", "Spark")]

#: Different documents in a partition.
EACH = 1000


def hits(documents: DataFrame) -> DataFrame:
    """Every document of (doc_key, raw) with one specimen of each family, and whether the wording check tells it from its twin.

    Both texts of all documents are laid out.  Documents whose plants and lines that a rule may bear on are alike, but for how far
    down they stand, have the same findings that far down, so one of them goes through the check for all.
    """
    if not all(re.search("[가-힣]", entry[0]) for entry in SPELLING + BRANDS):
        raise ValueError("a word without Hangul may be found on lines that are left out as bearing on no rule")
    spark = documents.sparkSession
    rows = planting.planted_rows(documents, SPECIMENS, F.col("doc_key"), F.pmod(F.col("doc_key") * 7, F.size(F.split("raw", "\n")) + 1))
    told = rows.select("doc_key", "plants", structure.planted_residue("raw", "at", "bad", "good").alias("of")).select("doc_key", "plants", "of.*")
    told = told.withColumn("plants", _moved("plants", -F.col("ahead")))
    told = told.withColumn("key", F.sha2(F.concat("residue", F.to_json("plants")), 256)).persist()  # read for the check and for its results
    # Every family has a task for each partition, so there are as many as the different documents need and not as all would.  What the
    # families read and make is kept without its plan, which each of some forty scans would hold again.
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), max(spark.sparkContext.defaultParallelism, told.select("key").distinct().count() // EACH))
    parsed = _kept(structure.residue_lines(told.select("key", "residue").distinct(), ("bad", "good"), n))
    spelling = spark.createDataFrame(SPELLING, "wrong string, right string, scope string, level string, excepts array<string>, why string")
    brands = spark.createDataFrame(BRANDS, "wrong string, canonical string")
    found = rules.markdown_findings(parsed, spelling, brands, parsed=parsed)
    key = F.split("doc_key", ":")
    found = _kept(found.select(key[0].alias("side"), key[1].alias("doc_key"), _place().alias("line_no"), "kind", "match", "note"))
    plants = told.select("key", "plants").distinct().select(F.col("key").alias("doc_key"), F.inline("plants"))
    caught = planting.caught(plants, found.where("side = 'bad'").drop("side"), found.where("side = 'good'").drop("side"))
    by_key = caught.groupBy(F.col("doc_key").alias("key")).agg(F.collect_list(F.struct(*[c for c in caught.columns if c != "doc_key"])).alias("plants"))
    return told.select("doc_key", "ahead", "key").join(by_key, "key").select("doc_key", F.inline(_moved("plants", F.col("ahead"), "found", "net")))


def _kept(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, which all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        from prosewright.llm.common import shared_dir

        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _moved(plants: str, by: Column, *more: str) -> Column:
    """Plants so many lines further down."""
    return F.transform(plants, lambda p: F.struct(*[p[c].alias(c) for c in ("family", "kind", "note")], *[(p[c] + by).alias(c) for c in ("first_line", "last_line")], *[p[c].alias(c) for c in more]))


def _place() -> Column:
    """The line a finding concerns; none for a mix of registers that is undecided, as all sentences make it and its line is the first one's."""
    return F.when(~((F.col("kind") == "register_mix") & (F.col("severity") == "warn")), F.col("line_no"))


def _plants_sql() -> str:
    """What is planted where, by the rule of ``hits``: behind line (7 * id) mod (lines + 1), families one after the other."""
    parts, ahead = [], "0"
    for family, own in planting.families(SPECIMENS).items():
        n = "[" + ", ".join(str(s.bad.count("\n") + 1) for s in own) + "]"
        listed = lambda name: "[" + ", ".join(f"'{getattr(s, name)}'" for s in own) + "]"  # noqa: B023, E731
        i = f"(((doc_key % {len(own)}) + {len(own)}) % {len(own)} + 1)"
        parts.append(f"SELECT doc_key, '{family}' AS family, {listed('kind')}[{i}] AS kind, {listed('note')}[{i}] AS note, CAST(place + 2 + {ahead} AS INT) AS first_line, CAST(place + 1 + {ahead} + {n}[{i}] AS INT) AS last_line FROM d")
        ahead += f" + {n}[{i}] + 2"
    sized = "d AS (SELECT doc_id AS doc_key, (doc_id * 7) % (len(string_split(coalesce(text, ''), chr(10))) + 1) AS place FROM documents)"
    return f"{sized}, p AS ({' UNION ALL '.join(parts)})"


PLANTS_SQL = _plants_sql()
