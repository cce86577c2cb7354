"""Text scalars as Spark columns: folding, slugs, query words, masking, citations. No Python runs per row
except in fold_any, for scripts beyond Latin; with_tokens cuts whole batches of texts as arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words without content in questions (Spanish, then English), compared without accents.
STOPWORDS = tuple(
    """
    a al algo alguna algunas alguno algunos ante antes como con contra cual cuales cuando de del desde donde
    dos el ella ellas ellos en entre era eran es esa esas ese eso esos esta estan estas este esto estos ha
    hace hacen hasta hay la las le les lo los mas me mi mis mucho muy no nos o os otra otras otro otros para
    pero poco por porque que quien quienes se sea sean ser si sin sobre su sus tambien tanto te tiene tienen
    tu tus un una uno unos y ya
    about all and any are as at be but by can did do does for from has have how in is it its of on or that
    the their there they this to was were what when where which who why with you your
    """.split()
)

#: Forms of explicit denial in an answer.
DENIALS = (
    "no consta", "no aparece", "no hay evidencia", "no hay registro", "ningún registro", "ninguna certificación",
    "no se menciona", "no se encontró", "no existe", "no figura", "no puedo", "no cuenta con", "no tiene",
    "no dispongo", "no dispone", "no tengo información", "no cuento con", "no obra",
)

#: Identifier patterns by name, in the order in which they are applied.
IDENTIFIERS = {
    "curp": r"\b[A-ZÑ][AEIOUX][A-ZÑ]{2}\d{6}[HM][A-Z]{5}[A-Z0-9]\d\b",
    "rfc": r"\b[A-ZÑ&]{3,4}\d{6}[A-Z0-9]{3}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "telefono": r"(?<![\d\w])(?:\+?52[\s.-]*)?\(?\d{2,3}\)?[\s.-]*\d{3,4}[\s.-]*\d{4}(?![\d\w])",
    "cedula": r"(?<![\d\w])\d{7,8}(?![\d\w])",
}
#: What every match of a pattern holds, as a cheap test before it.
HINTS = {"curp": r"\d{4}", "rfc": r"\d{4}", "email": "@", "telefono": r"\d{4}", "cedula": r"\d{4}"}
PERSONAL = ("curp", "rfc", "telefono", "cedula")
VISIBLE = 4
WORD = r"[\p{L}\p{N}_]+"


#: White space as a text's ends are stripped of, and line ends as texts are cut at them.
WHITE = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END, -1)


def _letters() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition is one character and marks; those characters, and after them the
    combining marks (which translate drops); and characters that stand for several. Hangul is not parted."""
    folded = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    ranges = (range(0xA0, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x1FC00), range(0x2F800, 0x2FA20))  # others have none
    known = [chr(p) for points in ranges for p in points]
    marks = [c for c in known if unicodedata.combining(c)]
    changed = {c: f for c in known if not unicodedata.combining(c) and (f := folded(c)) != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join([*single, *marks]), "".join(single.values()), {c: f for c, f in changed.items() if len(f) != 1}


_ACCENTED, _PLAIN, _LIGATURES = _letters()
#: Characters for several that texts of common scripts hold; the others are looked up one by one where they occur.
_COMMON = {c: f for c, f in _LIGATURES.items() if c < "\u0250" or c in "\u2025\u2026\u2033\u2122\u2116" or "\ufb00" <= c <= "\ufb06"}
_RARE = {c: f for c, f in _LIGATURES.items() if c not in _COMMON}


def _class(chars: Iterable[str]) -> str:
    """A regular expression for one of these characters, as ranges."""
    spans: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in spans) + "]"


_IS_COMMON, _IS_RARE = _class(_COMMON), _class(_RARE)
#: A cheap test that every text with a rare character passes; the exact one costs a class of hundreds of ranges.
_MAYBE_RARE = r"[\x{250}-\x{10FFFF}]"


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _bound(value: Column, f) -> Column:
    """f of a column that is a variable of its own, so that it is made once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _has_rare(plain: Column) -> Column:
    """Whether a text has characters of _RARE: whether it loses bytes where they are dropped."""
    dropped = F.translate(plain, "".join(_RARE), "")
    return plain.rlike(_MAYBE_RARE) & (F.octet_length(dropped) < F.octet_length(plain))


def fold(c: Column) -> Column:
    """Lower case without accents, by compatibility decomposition, for all scripts but Hangul, whose syllables stay
    whole; fold_any parts these, too. ASCII texts are only lowered."""

    def parted(plain: Column) -> Column:
        out = plain
        for ligature, letters in _COMMON.items():
            out = F.replace(out, F.lit(ligature), F.lit(letters))
        out = F.when(plain.rlike(_IS_COMMON), out).otherwise(plain)
        letters = F.from_json(F.lit(json.dumps(_RARE)), "map<string,string>")
        each = F.transform(F.split(out, ""), lambda x: F.when(x.rlike(_IS_RARE), F.element_at(letters, x)).otherwise(x))
        return F.when(_has_rare(plain), F.array_join(each, "")).otherwise(out)

    low = F.lower(c)
    return F.when(is_ascii(c), low).otherwise(_bound(F.translate(low, _ACCENTED, _PLAIN), parted))


def sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold_sql(x: str) -> str:
    """fold as SQL over an expression; for SQL functions, which cannot be called on a lambda's variable."""
    plain = f"translate(lower({x}), {sql_literal(_ACCENTED)}, {sql_literal(_PLAIN)})"
    parted = plain
    for ligature, letters in _COMMON.items():
        parted = f"replace({parted}, {sql_literal(ligature)}, {sql_literal(letters)})"
    parted = f"if({plain} rlike {sql_literal(_IS_COMMON)}, {parted}, {plain})"
    letters = f"from_json({sql_literal(json.dumps(_RARE))}, 'map<string,string>')"
    each = f"transform(split({parted}, ''), rare_ -> if(rare_ rlike {sql_literal(_IS_RARE)}, element_at({letters}, rare_), rare_))"
    rare = f"{plain} rlike {sql_literal(_MAYBE_RARE)} and {plain} rlike {sql_literal(_IS_RARE)}"
    return f"case when length({x}) = octet_length({x}) then lower({x}) when {rare} then array_join({each}, '') else {parted} end"


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """Lower case without accents, for any script."""
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    return texts.map(strip, na_action="ignore")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def doc_type(stem: Column) -> Column:
    """Type that a file name's slug suggests; the first rule that holds decides."""
    kind = lambda name: (
        F.when(name.startswith("cv"), "cv")
        .when(name.rlike("certificado|constancia"), "certificado")
        .when(name.rlike("titulo"), "titulo")
        .when(name.rlike("ficha|especificacion"), "ficha_tecnica")
        .when(name.rlike("folleto|catalogo|brochure"), "folleto")
        .otherwise("documento")
    )
    # as a variable of its own, the slug is made once and not for each rule
    return _bound(slug(stem), kind)


def year_in(c: Column) -> Column:
    found = F.regexp_extract(c, "(?:19|20)[0-9]{2}", 0)
    return F.when(found != "", found.cast("int"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def condense_words(c: Column) -> Column:
    """Lower-cased words of content, in order."""
    # words of ASCII letters are what they fold to
    content = lambda w: F.when(is_ascii(w), ~w.isin(*STOPWORDS)).otherwise(~fold(w).isin(*STOPWORDS))
    return F.filter(words(c), lambda w: (F.length(w) > 2) & content(w))


def condense(c: Column) -> Column:
    return F.array_join(condense_words(c), " ")


def plan_queries(question: Column, most: int = 2) -> Column:
    """The question, and its condensed form if that is neither empty nor the same."""
    asked, short = strip(question), condense(question)
    both = F.when((short == "") | (F.lower(short) == F.lower(asked)), F.array(asked)).otherwise(F.array(asked, short))
    return F.when(asked == "", F.array().cast("array<string>")).otherwise(F.slice(both, 1, most))


def token_set(c: Column) -> Column:
    """Distinct folded words of content."""
    # repeats go before words are folded, which they are together: no word holds a line end, nor does what it folds to
    long = F.filter(F.array_distinct(words(c)), lambda w: F.length(w) > 2)
    folded = lambda joined: F.split(fold(joined), "\n")
    content = lambda some: F.when(F.size(some) == 0, some).otherwise(F.array_distinct(F.filter(_bound(F.array_join(some, "\n"), folded), lambda w: ~w.isin(*STOPWORDS))))
    return _bound(long, content)


def chunk_tokens(text: Column, file_name: Column) -> Column:
    """Tokens of a chunk, which include those of its file name."""
    return F.array_distinct(F.concat(token_set(text), token_set(F.translate(file_name, "-_", "  "))))


#: Bytes of text that are cut at once, where a longer text is cut by itself; and words that a task remembers at most.
_CUT_BYTES, _MOST_KNOWN = 1 << 20, 200_000
#: Bytes of words, beyond ASCII any; and the bytes in lower case.
_WORD_BYTES = np.array([p > 127 or chr(p).isalnum() or p == 95 for p in range(256)])
_LOWER_BYTES = np.array([p + 32 * (65 <= p <= 90) for p in range(256)], np.uint8)
_STOPS = frozenset(STOPWORDS)
_STOP_BYTES = pa.array([w.encode() for w in STOPWORDS], pa.binary())
#: Its lower case depends on what stands around it, beyond its word.
_SIGMA = "\u03a3"


@cache
def _character_tables() -> tuple[str, dict[int, str], dict[int, str]]:
    """Spark's own rules for characters beyond ASCII: those of no word as a regular expression, those that lower()
    changes, and characters of words that fold() changes. Made once for each process."""
    spark = SparkSession.active()
    points = F.explode(F.split("s", "")).alias("c")
    blocks = ["".join(chr(p) for p in range(low, low + 128) if not 0xD800 <= p < 0xE000) for low in range(0x80, 0x110000, 128)]
    chars = spark.createDataFrame([(b,) for b in blocks if b], "s string").select(points)
    chars = chars.select("c", F.lower("c").alias("low"), F.col("c").rlike(WORD).alias("word")).filter((F.col("low") != F.col("c")) | F.col("word"))
    found = chars.select("c", "low", "word", F.when(F.col("word"), fold(F.col("c"))).alias("plain")).toArrow().to_pylist()
    lower = {ord(r["c"]): r["low"] for r in found if r["low"] != r["c"]}
    plain = {ord(r["c"]): r["plain"] for r in found if r["word"] and r["plain"] != r["c"]}
    spans = _class([r["c"] for r in found if r["word"]])[1:-1]
    spans = re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", spans)
    return f"[^0-9A-Za-z_{spans}]+", lower, plain


def _tokens_of(run: str, tables: tuple[re.Pattern, dict[int, str], dict[int, str]]) -> list[str]:
    """token_set of characters without a space, in lower case as far as they are ASCII."""
    between, lower, plain = tables
    long = [w for w in between.split(run.translate(lower)) if len(w) > 2]
    return [w for w in dict.fromkeys(w.translate(plain) for w in long) if w not in _STOPS]


def _cut(texts: pa.Array, tables: tuple, known: dict[bytes, list[str]]) -> pa.ListArray:
    """token_set of each text but for _SIGMA; known holds what words beyond ASCII stand for."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _WORD_BYTES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER_BYTES[data[inside]])]).dictionary_encode()
    names, width = runs.dictionary, max(1, len(runs.dictionary))
    owner, code = np.divmod(np.unique((np.searchsorted(ends, starts, side="right") - 1) * width + runs.indices.to_numpy()), width)
    at = names.buffers()[1] and np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    odd = np.zeros(len(names), bool)
    if len(names):
        odd = np.maximum.reduceat(np.frombuffer(names.buffers()[2], np.uint8)[: at[-1]], at[:-1]) > 127
    kept = ~odd & ~pc.less(pc.binary_length(names), 3).to_numpy(zero_copy_only=False) & ~pc.is_in(names, value_set=_STOP_BYTES).to_numpy(zero_copy_only=False)
    if len(known) > _MOST_KNOWN:
        known.clear()
    means = []
    for run in names.filter(pa.array(odd)).to_pylist():
        if run not in known:
            known[run] = _tokens_of(run.decode(errors="replace"), tables)
        means.append(known[run])
    # each run stands for the tokens from first[code] on, n[code] of them
    n = kept.astype(np.int64)
    n[odd] = [len(m) for m in means]
    plain = names.filter(pa.array(kept)).cast(pa.string())
    place = np.zeros(len(names), np.int64)
    place[kept] = np.arange(len(plain))
    place[odd] = len(plain) + np.cumsum(n[odd]) - n[odd]
    tokens = pa.concat_arrays([plain, pa.array([w for m in means for w in m], pa.string())]).dictionary_encode()
    each = n[code]
    owner, first = np.repeat(owner, each), np.repeat(place[code], each)
    token = tokens.indices.to_numpy()[first + np.arange(len(first)) - np.repeat(np.cumsum(each) - each, each)].astype(np.int64)
    width = max(1, len(tokens.dictionary))
    owner, token = np.divmod(np.unique(owner * width + token), width)
    bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), tokens.dictionary.take(pa.array(token)))


def with_tokens(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with a column, new or in place of one, of the token set of text in any order; null counts as empty. Words
    are found as arrays of bytes by Spark's own rules for characters, and each is folded once for many texts; only
    texts with a capital sigma are left to token_set."""
    kept = rows.withColumn(name, F.coalesce(text, F.lit("")))
    columns = [c for c in rows.columns if c != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != name), "_tokens array<string>, _sigma string"])
    between, *changed = _character_tables()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = (re.compile(between), *changed), {}
        for b in batches:
            at = b.schema.get_field_index(name)
            ends, lo = np.cumsum(pc.binary_length(b.column(at)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CUT_BYTES, side="right")))
                part = b.slice(lo, hi - lo)
                texts = part.column(at)
                special = pc.match_substring(texts, _SIGMA).to_pylist()
                whole = pa.array([texts[i].as_py() if x else None for i, x in enumerate(special)], pa.string())
                yield pa.RecordBatch.from_arrays([*map(part.column, columns), _cut(texts, tables, known), whole], [*columns, "_tokens", "_sigma"])
                lo = hi

    tokens = F.when(F.col("_sigma").isNull(), F.col("_tokens")).otherwise(token_set(F.col("_sigma")))
    return kept.mapInArrow(cut, schema).select(*columns, tokens.alias(name))


def chunk_text(text: Column, file_name: Column) -> Column:
    """What has the tokens of chunk_tokens: a chunk's text and, in a line of its own, the words of its file name."""
    return F.concat_ws("\n", text, F.translate(file_name, "-_", "  "))


def _mask(value: Column) -> Column:
    hidden = F.greatest(F.length(value) - VISIBLE, F.lit(0))
    return F.when(F.length(value) <= VISIBLE, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.repeat(F.lit("*"), hidden), F.right(value, F.lit(VISIBLE))))


def mask_identifiers(c: Column, names: Sequence[str] = PERSONAL, reveal: bool = False) -> Column:
    """All but the last four characters of each identifier become asterisks, pattern by pattern."""
    unknown = set(names) - set(IDENTIFIERS)
    if unknown:
        raise ValueError(f"unknown identifier patterns: {sorted(unknown)}")
    if reveal:
        return c
    raw, hints = c, sorted({HINTS[n] for n in names})
    for name, pattern in IDENTIFIERS.items():
        if name in names:
            p = "(?U)" + pattern
            parts, found = F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), 0)
            joined = F.array_join(F.zip_with(parts, found, lambda s, m: F.concat(F.coalesce(s, F.lit("")), F.coalesce(_mask(m), F.lit("")))), "")
            c = F.when(c.rlike(p), joined).otherwise(c)
    # most texts hold nothing that any pattern could match; they pass one short test
    return F.when(raw.rlike("(?U)" + "|".join(hints)), c).otherwise(raw) if hints else raw


def contains_identifier(c: Column, names: Sequence[str] = PERSONAL) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | c.rlike("(?U)" + IDENTIFIERS[name])
    return found


def text_fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def is_denial(answer: Column, decline: str | None = None) -> Column:
    marks = ([decline.lower().rstrip(".")] if decline else []) + list(DENIALS)
    low = F.lower(answer)
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))


def document_base(document_id: Column) -> Column:
    return F.split_part(F.regexp_replace(document_id, r"\.md$", ""), F.lit("--"), F.lit(1))


def chunk_document_id(stem: Column, index: Column, total: Column) -> Column:
    return F.when(total == 1, stem).otherwise(F.concat(stem, F.lit("--"), F.format_string("%03d", index)))


def citation(source: Column, document_id: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), document_id)


def is_grounded(answer: Column, citations: Column, decline: str) -> Column:
    """An answer that declines, or names one of its citations in brackets."""
    declined = F.contains(F.lower(answer), F.lit(decline.lower().rstrip(".")))
    return declined | F.exists(citations, lambda c: F.contains(answer, F.concat(F.lit("["), c, F.lit("]"))))


def collapsed_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[ \\t]+", " "))


def _table_lines(c: Column) -> Column:
    return F.transform(lines(c), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))


def table_rows(c: Column) -> Column:
    return F.size(F.filter(_table_lines(c), lambda x: x))


def table_blocks(c: Column) -> Column:
    """Runs of neighbouring table lines."""
    rows = _table_lines(c)
    before = F.concat(F.array(F.lit(False)), rows)
    return F.size(F.filter(F.zip_with(rows, before, lambda x, last: x & ~last), lambda x: x))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[^\\n.;]+[.;]?"), 0), strip), lambda s: s != "")


def best_sentence(query_tokens: Column, text: Column) -> Column:
    """The first sentence with most of the query's tokens; the first of all if none has any."""
    scored = F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(query_tokens, F.array_distinct(F.regexp_extract_all(fold(s), F.lit(WORD), 0)))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], F.lit(""))


def last_user_text(turns: Column) -> Column:
    """Text of the last user turn of an ordered array of (role, text)."""
    return F.coalesce(F.element_at(F.filter(turns, lambda t: t["role"] == "user"), -1)["text"], F.lit(""))
