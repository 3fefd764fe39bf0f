"""Scalar text functions as Column expressions (JVM side), one place for each rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of a line, digits of a heading number, marks that end a sentence.
BLANKS = " \t　\xa0"
NUMBER_CHARS = "0-9０-９一二三四五六七八九十百千零〇○两"
UNIT_CHARS = "章节回卷集部篇幕"
BOUNDARY_CHARS = r"\s:：、.．·—\-～~「『【《（(“"
PLAIN_END = "。，,；;"
PROSE_END = "。！？!?，,；;…」”』：:—～~"
SEPARATOR_CHARS = "*＊-—－_=＝~～·•◇◆○●□■☆★※#＃"
HEADING_CHARS = 50
NUMBERED = f"^第[{NUMBER_CHARS}]+[{UNIT_CHARS}]"
NUMBERED_BOUND = f"{NUMBERED}($|[{BOUNDARY_CHARS}])"
MARKDOWN = r"^#{1,6}\s+\S"
CHAPTER = r"(?i)^chapter\s+[0-9ivxlc]+\b"
BARE_NUMBER = r"^[0-9０-９]{1,4}[.、．]?$"
BARE_CJK_NUMBER = r"^[一二三四五六七八九十百零〇]{1,6}$"
#: What a heading looks like, and the marks that it doesn't end in then.
HEADINGS = ((MARKDOWN, ""), (NUMBERED_BOUND, PLAIN_END), (CHAPTER, PLAIN_END), (NUMBERED, PROSE_END), (BARE_NUMBER, PROSE_END), (BARE_CJK_NUMBER, PROSE_END))
#: The controlled attributes, what else is filed under, and attribute characters folded.
ATTRIBUTES = ("年龄", "性别", "外貌", "籍贯", "出身", "亲属", "师承", "身份", "官职", "称号", "别名", "所属", "居所", "性格", "本领", "兵器", "坐骑", "伤病", "生死", "位置", "归属", "规模", "来历", "形制")
OTHER_ATTRIBUTE = "其他"
ATTRIBUTE_FOLD = ("齡別貫親屬師職稱號領騎傷歸規來歷製", "龄别贯亲属师职称号领骑伤归规来历制")
#: Characters without weight in a loose comparison.
LOOSE_CHARS = "的了着过之其此"
NOISE = r"[^\p{L}\p{N}]+"


def normalize(s: Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(s, NOISE, "")


def strip_blanks(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def one_line(s: Column) -> Column:
    """White-space runs as one space, none at the ends; null as empty."""
    return F.btrim(F.regexp_replace(F.coalesce(s, F.lit("")), r"[\s　\xa0]+", " "))


def loose_key(s: Column) -> Column:
    """For comparing hooks: without spaces, punctuation and particles."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), rf"[\s\p{{P}}\p{{S}}{LOOSE_CHARS}]", "")


def fold(s: Column, table: tuple[str, str] = ATTRIBUTE_FOLD) -> Column:
    """Characters of table[0] as those of table[1]; for comparison, never for display.  A full
    traditional-to-simplified table is a parameter: two strings of equal length."""
    if len(table[0]) != len(table[1]):
        raise ValueError("a fold table needs two strings of equal length")
    return F.translate(F.coalesce(s, F.lit("")), *table)


def norm_attribute(s: Column) -> Column:
    """An attribute name in the controlled list, or OTHER_ATTRIBUTE."""
    bare = F.regexp_replace(fold(s), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(bare.isin(*ATTRIBUTES), bare).otherwise(OTHER_ATTRIBUTE)


def padded(number: Column, width: int) -> Column:
    """A whole number with leading zeros up to ``width``; a longer one stays whole, which lpad would cut."""
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def natural_key(s: Column) -> Column:
    """An array that sorts texts with digit runs by value and the rest without case.  A digit
    run is its length without leading zeros and then itself, so runs of any length compare by value."""
    parts = F.regexp_extract_all(F.concat(F.lit(""), s), F.lit(r"(\d+|\D+)"), 1)
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(padded(F.length(bare(p)), 10), bare(p))).otherwise(F.lower(p)))


def natural_text(s: Column) -> Column:
    """The same as one text: digit runs behind their lengths, the rest lower-cased."""
    return F.array_join(natural_key(s), "\x01")


def is_blank(line: Column) -> Column:
    return strip_blanks(line) == ""


def is_separator(line: Column) -> Column:
    bare = F.regexp_replace(line, r"[\s　\xa0]+", "")
    return (F.length(bare) >= 3) & (F.translate(bare, SEPARATOR_CHARS, "") == "")


def is_heading(line: Column) -> Column:
    """Short, and of one of HEADINGS' shapes without its end marks."""
    s = strip_blanks(line)
    shaped = F.lit(False)
    for pattern, ends in HEADINGS:
        shaped = shaped | (s.rlike(pattern) & ~F.lit(ends).contains(F.right(s, F.lit(1))))
    return (s != "") & (F.length(s) <= HEADING_CHARS) & shaped


def heading_level(line: Column) -> Column:
    """md<n>, the unit character, chapter, num, or null."""
    s = strip_blanks(line)
    return (
        F.when(s.rlike(MARKDOWN), F.concat(F.lit("md"), F.length(F.regexp_extract(s, "^(#+)", 1)).cast("string")))
        .when(s.rlike(NUMBERED), F.regexp_extract(s, f"^第[{NUMBER_CHARS}]+([{UNIT_CHARS}])", 1))
        .when(s.rlike(CHAPTER), "chapter")
        .when(s.rlike(BARE_NUMBER) | s.rlike(BARE_CJK_NUMBER), "num")
    )


def clean_heading(s: Column) -> Column:
    return F.regexp_replace(s, r"^#{1,6}\s+", "")


def safe_name(s: Column) -> Column:
    """A text as a file name: reserved characters as _, no dots or spaces at the ends."""
    return F.btrim(F.btrim(F.btrim(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_")), F.lit(".")))


def now_iso() -> Column:
    """The query's time in the session's zone, to the second; never part of what is compared."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def shortened(s: Column, most: int) -> Column:
    """A long text's beginning and an ellipsis, for fixtures."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def short_hash(s: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(s.cast("binary"), 256), 1, digits)


def signature(*parts: Column, digits: int = 64) -> Column:
    """sha256 of the parts between unit separators; null parts are empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, digits)


def scene_refs(s: Column) -> Column:
    """S- numbers inside square brackets, in order: [S-0003], [S-0001、S-0002]."""
    groups = F.regexp_extract_all(s, F.lit(r"\[((?:S-\d{4,})(?:[,，、\s]+S-\d{4,})*)\]"), 1)
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(S-\d{4,})"), 1)))


#: Scene numbers in brackets, as a pattern.
REFERENCE = r"\[S-\d{4,}(?:[,，、\s]+S-\d{4,})*\]"


def ref_parts(s: Column) -> Column:
    """A text as array<struct<text, refs>>: bracketed scene numbers with those they name, and what stands between them with none, in
    order and without empty ones; joined they are the text."""
    tokens = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(rf"({REFERENCE}|[^\[]+|\[)"), 1)
    is_ref = lambda p: p.rlike(f"^{REFERENCE}$")

    def joined(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fresh = (F.size(done) == 0) | is_ref(p) | is_ref(last)
        return F.when(fresh, F.array_append(done, p)).otherwise(F.array_append(F.slice(done, 1, F.size(done) - 1), F.concat(last, p)))

    parts = F.aggregate(tokens, F.array().cast("array<string>"), joined)
    return F.transform(parts, lambda p: F.struct(p.alias("text"), F.when(is_ref(p), scene_refs(p)).otherwise(F.array().cast("array<string>")).alias("refs")))


def short_line(s: Column) -> Column:
    return F.substring_index(s, "｜", 3)


def format_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, with an exponent below 1e-4 and from 1e6 on
    (0.5, 1.23457e+06, 1e-05); nan, inf and -inf by name; ? for null."""
    x = x.cast("double")
    digits = F.format_string("%.5e", x)  # -1.23457e+06
    power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")
    trim = lambda s: F.regexp_replace(s, r"(\.\d*?)0+$", "$1")
    bare = lambda s: F.regexp_replace(trim(s), r"\.$", "")
    out = F.when(x.isNull(), "?").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
    for e in range(-4, 6):
        out = out.when(power == e, bare(F.format_string(f"%.{5 - e}f", x)))
    return out.otherwise(F.concat(bare(F.substring_index(digits, "e", 1)), F.lit("e"), F.substring_index(digits, "e", -1)))


def parse_json_object(s: Column, schema: str) -> Column:
    """A model's reply, code fences stripped, as a struct; null where it is no object."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(s), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return F.when(bare.startswith("{"), F.from_json(bare, schema, {"mode": "PERMISSIVE"}))


def script_of(s: Column, traditional: str, simplified: str) -> Column:
    """trad or simp by which table's characters occur more; ties are simp."""
    count = lambda t: F.length(s) - F.length(F.translate(s, t, ""))
    return F.when(count(traditional) > count(simplified), "trad").otherwise("simp")
