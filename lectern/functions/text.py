"""Text expressions. Word boundaries are ASCII, white space is Unicode, as the semantics ask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHARS_PER_TOKEN = 2.38
GERMAN_MARKERS = ("der", "die", "das", "und", "nicht", "eine", "für", "wird", "sind")
ENGLISH_MARKERS = ("the", "and", "of", "is", "for", "with", "that", "are", "this")
LIGATURE_DAMAGE = (
    "rst", "nal", "nally", "ctitious", "nite", "nitely", "dened", "coe cient", "coe cients", "su cient", "signi cant", "signi cantly", "speci c", "speci cally",
    "classi cation", "identi ed", "simpli ed", "modi ed", "satis ed", "con guration", "pro t", "bene t",
)
ALT_TEXT = ("superscript base", "end base", "to the cap", "asterisk operator", "subscript base", "end subscript")
BLANK = r"[\s\x1C-\x1F\p{Z}&&[^\x{A0}\x{2007}\x{202F}]]"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whole_word(alternatives: str) -> str:
    """A pattern for whole words, with boundaries that only ASCII letters, digits and the underscore make."""
    return rf"(?<![0-9A-Za-z_])(?:{alternatives})(?![0-9A-Za-z_])"


def strip(x) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(x), rf"^{BLANK}+|{BLANK}+$", "")


def is_blank(x) -> Column:
    return col(x).isNull() | (strip(x) == "")


def utf16_length(x) -> Column:
    """Length in UTF-16 units: code points beyond the basic plane count twice."""
    x = col(x)
    return F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def approx_tokens(characters) -> Column:
    """Estimated tokens of a number of characters, null as none."""
    return F.coalesce(F.ceil(col(characters) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def count_of(x, pattern: str) -> Column:
    return F.regexp_count(col(x), F.lit(pattern)).cast("long")


def damage_count(x) -> Column:
    """Words that only a lost ligature explains."""
    return count_of(x, whole_word("|".join(LIGATURE_DAMAGE)))


def looks_damaged(x) -> Column:
    return F.coalesce(damage_count(x) > 0, F.lit(False))


def alt_text_count(x) -> Column:
    """Phrases of screen-reader text."""
    return count_of(x, "(?i)" + whole_word("|".join(ALT_TEXT)))


def marker_count(x, markers: tuple[str, ...]) -> Column:
    """Whole-word occurrences of all markers."""
    return count_of(x, whole_word("|".join(markers)))


def language_of(german, english) -> Column:
    """From marker counts: a tie goes to English."""
    german, english = col(german), col(english)
    return F.when((german == 0) & (english == 0), "unknown").when(german > english, "de").otherwise("en")


def lecture_name(document) -> Column:
    d = col(document)
    return F.when(F.instr(d, "/") > 0, F.substring_index(d, "/", 1)).otherwise("(root)")


def unit_name(document) -> Column:
    return F.regexp_replace(F.substring_index(col(document), "/", -1), r"(?i)\.pdf$", "")


def role_of(unit) -> Column:
    """Source role from a file name; the first that fits."""
    n = F.lower(col(unit))
    return (
        F.when(n.contains("solution") | n.contains("loesung") | n.contains("lösung"), "SOLUTION")
        .when(n.startswith("ce ") | n.contains("central exercise") | n.contains("demoaufgaben"), "CENTRAL_EXERCISE")
        .when(n.contains("tutorial") | n.contains("uebungsaufgaben") | n.contains("übungsaufgaben"), "TUTORIAL")
        .when(n.rlike(r"^[0-9]+[ _]"), "LECTURE_DECK")
        .otherwise("OTHER")
    )


def to_query(folder) -> Column:
    """A folder name as a search query: no ordinal in front, underscores and spaces closed up."""
    x = F.regexp_replace(col(folder), r"^[0-9]+\s+", "")
    return strip(F.regexp_replace(F.regexp_replace(x, "_{2,}", " "), r"\s{2,}", " "))


def _dashed(x: Column, other: str) -> Column:
    return F.regexp_replace(F.regexp_replace(x, other, "-"), "^-+|-+$", "")


def slug_letters(x) -> Column:
    """Any letters and digits, lower case."""
    return _dashed(F.lower(col(x)), r"[^\p{L}\p{N}]+")


def slug_ascii(x) -> Column:
    """ASCII letters and digits, lower case; null as empty."""
    return _dashed(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9]+")


def slug_file(x) -> Column:
    """Safe in a file name, case kept."""
    return _dashed(col(x), "[^A-Za-z0-9._-]+")


def slug_latin(x) -> Column:
    """ASCII and Latin letters from U+00C0 to U+024F."""
    return _dashed(F.lower(col(x)), r"[^0-9A-Za-z\x{C0}-\x{24F}]+")


def page_range(first, last) -> Column:
    first, last = col(first), col(last)
    return F.when(first == last, F.format_string("Page %d", first)).otherwise(F.format_string("Pages %d–%d", first, last))


def chunk_id(document, first, last) -> Column:
    return F.concat(col(document), F.lit("#p"), col(first).cast("string"), F.lit("-"), col(last).cast("string"))


def chunk_document(chunk) -> Column:
    """What stands before the last ``#``; the whole id without one."""
    return F.regexp_replace(col(chunk), r"#[^#]*$", "")


def chunk_first_page(chunk) -> Column:
    """The first page, 0 where it can't be read."""
    return F.coalesce(F.regexp_extract(col(chunk), r"#p?(-?[0-9]+)(?:-[^#]*)?$", 1).try_cast("int"), F.lit(0))


def chunk_lecture(chunk) -> Column:
    """What stands before the first ``/``, else empty."""
    c = col(chunk)
    return F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1)).otherwise("")


def cell_key(course, competency, language, kind, difficulty) -> Column:
    return F.concat_ws("|", *[col(x) for x in (course, competency, language, kind, difficulty)])


def cell_of(key) -> Column:
    """The five parts of a cell key; an error if there aren't five."""
    parts = F.split(col(key), r"\|", -1)
    names = ("course_key", "competency_key", "language", "question_type", "difficulty_band")
    ok = F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return F.when(F.size(parts) == 5, ok).otherwise(F.raise_error(F.concat(F.lit("not a cell key: "), col(key))))


def configuration_id(approach, generator, judge, selector) -> Column:
    return F.concat_ws("|", *[col(x) for x in (approach, generator, judge, selector)])


def difficulty_band(level) -> Column:
    level = col(level)
    return F.when(level < 30, "easy").when(level <= 70, "medium").otherwise("hard")


def domain_of(course) -> Column:
    c = col(course)
    return F.when(c == "EIDI", "java").when(c.isin("EIST", "PSE"), "se").otherwise(F.lower(c))


def _objective_lines(description) -> Column:
    lines = F.filter(F.transform(F.split(col(description), r"\r\n|\r|\n"), strip), lambda x: x != "")
    return F.transform(lines, lambda x: F.when(x.startswith("- "), F.substring(x, 3, 1 << 30)).otherwise(x))


def objective(title, description) -> Column:
    """``title — objectives`` on one line, the title alone without objectives."""
    title = col(title)
    return F.when(is_blank(description), title).otherwise(F.concat(title, F.lit(" — "), F.concat_ws(" ", _objective_lines(description))))


def retrieval_query(query, title, description) -> Column:
    """The query, or title and description without bullets."""
    plain = F.replace(F.replace(F.coalesce(col(description), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("- "), F.lit(""))
    return F.when(~is_blank(query), col(query)).when(is_blank(description), col(title)).otherwise(F.concat(col(title), F.lit(". "), plain))


def normalise(x) -> Column:
    """Lower case, runs of ASCII white space as one space, stripped."""
    return strip(F.regexp_replace(F.lower(col(x)), r"\s+", " "))


def normalise_option(x) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"\s+", " "), "[.,;:]+$", ""))


def language_name(code) -> Column:
    c = F.lower(col(code))
    return F.when(c == "en", "English").when(c == "de", "German").otherwise(col(code))


def type_name(kind) -> Column:
    return F.replace(col(kind), F.lit("-"), F.lit("_"))


def same_model(a, b) -> Column:
    """Equal, or one is the other with a tag."""
    a, b = col(a), col(b)
    return (a == b) | a.startswith(F.concat(b, F.lit(":"))) | b.startswith(F.concat(a, F.lit(":")))


def manifest_lines(text) -> Column:
    """``key=value`` lines as a map; the first ``=`` parts them, lines without one are left out, the last of a key counts."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: F.instr(x, "=") > 0)
    pair = F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=", "").alias("value")))
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def backoff_ms(attempt) -> Column:
    """Wait before another attempt: a second doubling to half a minute."""
    return F.least(F.lit(30_000), F.lit(1_000) * F.pow(F.lit(2), col(attempt) - 1)).cast("long")


def http_kind(status) -> Column:
    """Class of a failed call from its HTTP status."""
    s = col(status)
    return F.when(s.isin(401, 403), "AUTH").when(s == 429, "RATE_LIMIT").when(s == 408, "TIMEOUT").when(s >= 500, "TRANSPORT").when(s >= 400, "BAD_REQUEST").otherwise("TRANSPORT")


def retryable(category) -> Column:
    """All but the two that fail alike on every attempt; unknown and null ones too."""
    return ~F.coalesce(col(category).isin("AUTH", "BAD_REQUEST"), F.lit(False))


def percent(share, digits: int = 0) -> Column:
    """A share as ``12%``; ``-`` where there is none."""
    return F.when(col(share).isNull(), "-").otherwise(F.format_string(f"%.{digits}f%%", col(share).cast("double") * 100))


def band(low, high) -> Column:
    """Two amounts as ``low-high``, one if they are equal, ``n/a`` without them."""
    low, high = col(low), col(high)
    none = low.isNull() | high.isNull() | F.isnan(low.cast("double")) | F.isnan(high.cast("double"))
    both = F.when(low == high, F.format_string("%.4f", low)).otherwise(F.format_string("%.4f-%.4f", low, high))
    return F.when(none, "n/a").otherwise(both)


def composition_text(counts, fraction, unknown) -> Column:
    """``2 lecture deck, 1 solution, 1 unknown (25% solution)`` of a map from role to number, roles by name."""
    named = F.transform(F.array_sort(F.map_entries(col(counts))), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), F.replace(F.lower(e["key"]), F.lit("_"), F.lit(" "))))
    rest = F.when(col(unknown) > 0, F.array(F.concat(col(unknown).cast("string"), F.lit(" unknown")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.coalesce(named, F.array().cast("array<string>")), rest)
    return F.concat(F.array_join(parts, ", "), F.lit(" ("), percent(fraction), F.lit(" solution)"))
