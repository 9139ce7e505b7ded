"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = "가-힣"
FIRST_SYLLABLE, FINALS = 0xAC00, 28


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(c), lambda x: body(x)), 1)


def squeeze(c: Column | str) -> Column:
    """White-space runs (Unicode) to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), r"^ | $", "")


def strip(c: Column | str) -> Column:
    """Without white space (Unicode) at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def shown(c: Column | str) -> Column:
    """Holds more than white space (Unicode)."""
    return col(c).rlike(r"(?U)\S")


def hangul_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(f"[{HANGUL}]"))


def line_key(c: Column | str) -> Column:
    """Identity of a line: 12 hex digits of the squeezed text's sha256; null without Hangul."""
    return F.when(col(c).rlike(f"[{HANGUL}]"), F.substring(F.sha2(squeeze(c).cast("binary"), 256), 1, 12))


def form_key(c: Column | str) -> Column:
    """Identity that survives list, heading and quote marks and emphasis; prefixed f."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s*(?:(?:[-*+>]|#{1,6}|\d+[.)])\s+)+", ""), r"[*_]", "")
    return F.concat(F.lit("f"), line_key(bare))


def short_sha1(c: Column | str, digits: int = 16) -> Column:
    return F.substring(F.sha1(squeeze(c).cast("binary")), 1, digits)


def content_digest(c: Column | str) -> Column:
    """16 hex digits of the sha256 of the text with LF line ends."""
    return F.substring(F.sha2(F.replace(col(c), F.lit("\r\n"), F.lit("\n")).cast("binary"), 256), 1, 16)


def rule_key(detector: Column | str, pattern: Column | str, original: Column | str) -> Column:
    return F.concat(col(detector), F.lit(":"), F.when(col(detector) == "regex", col(pattern)).otherwise(col(original)))


def size_bucket(n_bytes: Column | str) -> Column:
    return F.when(col(n_bytes) < 4096, "small").when(col(n_bytes) < 20480, "medium").otherwise("large")


def final_consonant(c: Column | str) -> Column:
    """Index of a syllable's final consonant (0: none); -1 for anything but a Hangul syllable."""
    code = F.ascii(col(c))
    return F.when((code >= FIRST_SYLLABLE) & (code < FIRST_SYLLABLE + 11172), (code - FIRST_SYLLABLE) % FINALS).otherwise(F.lit(-1))


def with_final(c: Column | str, final: Column | int) -> Column:
    """The syllable with another final consonant."""
    code = F.ascii(col(c))
    return F.decode(F.unhex(F.lpad(F.hex(code - (code - FIRST_SYLLABLE) % FINALS + final), 8, "0")), "UTF-32")


# Endings of polite speech; those that begin with 니다 or 시다 need a ㅂ final (17) before them.
POLITE_END = r"(?:니다|니까|세요|셔요|어요|아요|여요|에요|예요|시오|시다)$"


def is_polite(c: Column | str) -> Column:
    def judged(text):
        needs = text.rlike("(?:니다|시다)$") & ~text.rlike("(?:세요|셔요|어요|아요|여요|에요|예요|시오|니까)$")
        before = F.substring(F.regexp_replace(text, r"(?:니다|시다)$", ""), -1, 1)
        return text.rlike(POLITE_END) & (~needs | (final_consonant(before) == 17))

    return let(col(c), judged)


CODE_SPAN = r"`[^`]*`"
QUOTE_SPAN = r"[「『][^」』]*[」』]|\"[^\"]*\"|“[^”]*”"


def mask(c: Column | str, by: str = " ") -> Column:
    """Inline code and quotations replaced, as rules about wording must not see what is only quoted."""
    return F.regexp_replace(F.regexp_replace(col(c), CODE_SPAN, by), QUOTE_SPAN, by)


def is_example(c: Column | str) -> Column:
    """A contrast example: both marks on one line, or a mark with a quotation."""
    text = col(c)
    return text.rlike("[❌✅✗✓○×⭕]") & ((text.contains("❌") & text.contains("✅")) | text.rlike(QUOTE_SPAN))


def plain_markup(c: Column | str) -> Column:
    """Markup characters to spaces, one for one."""
    marks = "*`#~_|>\"'[]()-–—+="
    return F.translate(col(c), marks, " " * len(marks))


# A link at a value's end, and particles after which its text is needed.
LINK = r"\s*\[([^\]]+)\]\([^)]*\)[.。]?\s*$"


def drop_tail(c: Column | str) -> Column:
    """Without trailing link, parentheses and emphasis; a trailing link after a particle is kept as its text."""

    def unlinked(text):
        def cut(before):
            needs_noun = before.rlike(r"[가-힣](?:은|는|이|가|을|를|와|과|의|도)\s*$|(?:및|또는)\s*$")
            return F.concat(F.rtrim(before), F.when(needs_noun, F.concat(F.lit(" "), F.regexp_extract(text, LINK, 1))).otherwise(F.lit("")))

        return F.when(text.rlike(LINK), let(F.regexp_replace(text, LINK, ""), cut)).otherwise(text)

    text = F.regexp_replace(let(strip(c), unlinked), r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(?U)(?:\s*(?:\([^)]*\)|\[[^\]]*\]|（[^）]*）)[.。]?\s*)+$", "")
    return F.regexp_replace(text, "[\"'」』)*_`~”’]+$", "")


def all_quoted(c: Column | str) -> Column:
    """The whole value is a quotation or a name in corner brackets."""

    def judged(base):
        rest = F.regexp_replace(F.regexp_replace(base, QUOTE_SPAN, " "), r"[ \t\r\n≠=·\-—*_`~]", "")
        return base.rlike(r"^[「『][^」』]+[」』]$") | (rest == "")

    return let(F.regexp_replace(F.replace(strip_tags(c), F.lit("**"), F.lit("")), r"^[ *_`~]+|[ *_`~]+$", ""), judged)


def is_narrative(c: Column | str) -> Column:
    """The value ends like a sentence (…다), quotations apart."""
    probe = drop_tail(F.regexp_replace(col(c), QUOTE_SPAN, " "))
    return col(c).contains("다") & probe.rlike(r"(?<!보|마|최|과)(?<=[가-힣])다\.?$")  # the cheap test first


def is_plain_speech(c: Column | str) -> Column:
    probe = F.regexp_replace(drop_tail(F.regexp_replace(col(c), QUOTE_SPAN, " ")), r"[.!?… ]+$", "")
    return is_narrative(c) & ~is_polite(probe)


BLOCK_TAGS = "p|div|dl|dt|dd|li|ul|ol|table|thead|tbody|tr|th|td|section|article|h[1-6]|header|footer|nav|aside|main|figure|figcaption|blockquote|pre|hr"


def strip_tags(c: Column | str) -> Column:
    """Block tags to line ends, line breaks to spaces, other tags away."""
    text = F.regexp_replace(col(c), r"(?i)<br\b[^>]*>", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    return strip(F.regexp_replace(text, r"<[^>]+>", ""))


# Named character references and what they stand for; & comes last.
ENTITIES = [
    ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&apos;", "'"), ("&nbsp;?", "\u00a0"), ("&copy;?", "©"), ("&reg;?", "®"), ("&middot;?", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&times;?", "×"), ("&amp;?", "&"),
]


def unescape_html(c: Column | str) -> Column:
    """Character references to characters: decimal and hexadecimal ones, and the named ones of ENTITIES."""

    def numbered(text):
        refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"), F.lit(1)))

        def replaced(t, ref):
            digits = F.regexp_extract(ref, "&#[xX]?([0-9A-Fa-f]+);", 1)
            code = F.when(F.lower(ref).startswith("&#x"), F.lpad(digits, 8, "0")).otherwise(F.lpad(F.hex(digits.cast("long")), 8, "0"))
            shown = F.when((code > "0010FFFF") | code.between("0000D800", "0000DFFF"), "\ufffd").otherwise(F.decode(F.unhex(F.upper(code)), "UTF-32"))
            return F.replace(t, ref, shown)

        return F.when(text.contains("&#"), F.aggregate(refs, text, replaced)).otherwise(text)

    def named(text):
        for pattern, by in ENTITIES:
            text = F.regexp_replace(text, pattern, by)
        return text

    return let(col(c), lambda t: F.when(t.contains("&"), named(numbered(t))).otherwise(t))


def sentences(c: Column | str) -> Column:
    """Sentences of a value, none if it is all quoted."""
    parts = F.filter(F.transform(F.split(strip_tags(c), r"(?<=다\.)\s+"), lambda s: strip(s)), lambda s: ~s.rlike(r"^[-: ]*$"))
    return F.when(all_quoted(c), F.array().cast("array<string>")).otherwise(parts)


# Endings and question words of cut-off values.
CUT_PARTICLE = r"[가-힣](?:에서|에게|한테|으로|로서|로써|를|는|에)$"
TIME_PHRASE = r"(?:전|후|뒤|중|사이|동안)에$"
SOFT_PARTICLE = r"[가-힣](?:만|까지|부터|로)$"
LO_WORD = r"(?:경로|도로|회로|진로|통로|대로|선로|항로|수로|미로|플로|별로|서로|따로|새로|바로|주로|실로|종로)$"
QUESTION_WORD = r"무엇|뭐|어디|언제|누가|누구|왜|어떻게|어떤|얼마|몇|어느"
STRONG_QUESTION_WORD = r"무엇|뭐|어디|언제|누가|누구|왜|어떻게"


def fragment(c: Column | str) -> Column:
    """struct(err, warn): why a value is cut off or a question, else nulls."""

    def judged(text):
        err = (
            F.when(text.rlike(CUT_PARTICLE) & ~text.rlike(TIME_PHRASE), "cut after a particle")
            .when(text.rlike(QUESTION_WORD) & text.rlike(r"(?<!하)나$"), "label as a question")
            .when(text.rlike(STRONG_QUESTION_WORD) & text.rlike("하나$"), "label as a question")
        )
        warn = F.when(text.rlike(SOFT_PARTICLE) & ~text.rlike(LO_WORD), "ends in a particle").when(text.rlike(QUESTION_WORD) & text.rlike("(?:까|는가|은가|인가|을까)$"), "question label")
        named = (text == "") | text.rlike(r"^[「『][^」』]+[」』]$")
        return F.struct(F.when(~named, err).alias("err"), F.when(~named & err.isNull(), warn).alias("warn"))

    return let(strip(c), judged)


def excerpt(line: Column | str, found: Column | str, width: int = 60) -> Column:
    """The line's beginning, or the surroundings of what was found if that lies beyond."""
    text, at = strip_tags(line), F.instr(strip_tags(line), col(found))
    begin = F.greatest(F.lit(1), at - width // 3)
    far = (at > 0) & (at - 1 + F.length(col(found)) > width)
    return F.when(far, F.concat(F.lit("…"), F.substring(text, begin, F.lit(width)))).otherwise(F.substring(text, 1, width))


def terminal_text(c: Column | str) -> Column:
    """Without ANSI control sequences."""
    return F.regexp_replace(col(c), "\u001b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\u0007\u001b]*(?:\u0007|\u001b\\\\))", "")


def json_pointer(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def heading_slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s-]", ""), r"(?U)\s", "-")


def visible(c: Column | str) -> Column:
    """Without emphasis, link targets and tags."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"<[^>]+>", ""), r"[*_`]", "")


def gap_bucket(seconds: Column | str) -> Column:
    return F.when(col(seconds).isNull(), "none").when(col(seconds) <= 300, "up to 5 min").when(col(seconds) <= 3600, "5 to 60 min").otherwise("over 60 min")


def share(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(col(part), col(whole))


def change_level(rate: Column | str) -> Column:
    return F.when(col(rate) >= 0.5, "high").when(col(rate) >= 0.3, "warn").otherwise("ok")


def word_at(text: Column | str, at: Column | str) -> Column:
    """The white-space-delimited word around a 0-based offset."""
    left = F.regexp_extract(F.substring(col(text), F.lit(1), col(at)), r"\S*$", 0)
    return F.concat(left, F.regexp_extract(F.substring(col(text), col(at) + 1, F.length(col(text)) + 1), r"^\S*", 0))


def subject_particle(word: Column | str) -> Column:
    """이 or 가, by the last syllable's final consonant."""
    return F.when(final_consonant(F.substring(col(word), -1, 1)) == 0, "가").otherwise("이")


def shares_run(a: Column | str, b: Column | str, n: int) -> Column:
    """Some n characters in a row of ``a`` are in ``b``."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(col(a)) - n + 1))
    return (F.length(col(a)) >= n) & F.exists(starts, lambda i: F.contains(col(b), F.substring(col(a), i, F.lit(n))))


def bigrams(c: Column | str) -> Column:
    """Two-character pieces of each word, numbers as one piece #n."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"[가-힣]+|[a-z]+|\d+"), F.lit(0))

    def pieces(w):
        pairs = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(w.rlike(r"^\d"), F.array(F.concat(F.lit("#"), w))).when(F.length(w) < 2, F.array().cast("array<string>")).otherwise(pairs)

    return F.flatten(F.transform(words, pieces))


# Particles that go with a final consonant, and without one.
PARTICLE_PAIRS = [("은", "는"), ("이", "가"), ("을", "를"), ("과", "와")]


def fit_particle(word: Column | str, rest: Column | str) -> Column:
    """What follows a word, its first particle made to fit the word's final consonant (으로 also goes to 로 after ㄹ)."""
    final = final_consonant(F.substring(col(word), -1, 1))
    out = F.when(col(rest).rlike("^(?:으로|로)(?![가-힣])") & (final >= 0), F.concat(F.when((final == 0) | (final == 8), "로").otherwise("으로"), F.regexp_replace(col(rest), "^(?:으로|로)", "")))
    for closed, opened in PARTICLE_PAIRS:
        fits = col(rest).rlike(f"^[{closed}{opened}](?![가-힣])") & (final >= 0)
        out = out.when(fits, F.concat(F.when(final == 0, opened).otherwise(closed), F.substring(col(rest), F.lit(2), F.length(col(rest)))))
    return out.otherwise(col(rest))


def front_matter(raw: Column | str) -> Column:
    """Flat ``key: value`` lines of the front matter as a map; of a key that repeats the last one holds."""
    head = F.regexp_extract(col(raw), r"(?s)^---\n(.*?)\n---", 1)
    rows = F.filter(F.split(head, "\n"), lambda r: r.rlike(r"^\w[\w-]*:"))
    pairs = F.transform(rows, lambda r: F.struct(F.regexp_extract(r, r"^(\w[\w-]*):", 1).alias("k"), F.trim(F.regexp_replace(r, r"^\w[\w-]*:", "")).alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda p: p["k"] == k), -1)["v"]))


def placed(text: Column | str, pattern: str) -> Column:
    """Matches of a pattern (Java syntax, no group) as (match, start): starts follow from the pieces between the matches."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    before = lambda i: F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(hits, F.lit(1), i), ""))
    return F.transform(hits, lambda h, i: F.struct(h.alias("match"), before(i).alias("start")))
