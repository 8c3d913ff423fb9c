"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers (in digits, or spelt out from two on), names (capitalised words that do not begin a sentence) and units
after a number become typed placeholders, so that a question with other numbers or names keeps its template.  Every window of
``WINDOW`` = 8 tokens is hashed, in documents and benchmark alike, and hash-joined.  Matches of a document
and an item are aligned by the difference of their places; along one alignment the values that fill the
item's slots must map consistently to the document's (one item value, one document value).  A pair is
reported if one consistent alignment has at least half of the item's windows, or ``ENOUGH`` = 6 of them
(13 tokens in a row).  An item of fewer than 8 tokens is one window of its own length.

Windows of fewer than ``LITERAL`` = 4 literal tokens say too little without their values: they are matched
on the raw tokens, so only word for word.  An alignment is enough by its windows with literals alone, or by
all of the item's.

Contract: one row per (doc_id, item_id) found: doc_id, item_id, n_windows matched by the best alignment,
item_windows, reparameterised (some slot differs).  Null and empty texts match nothing.  Repeated rows of
either table count once per id.  Other columns are ignored.

The benchmark's windows are broadcast only if they number at most ``BROADCAST_WINDOWS``.  Beyond that hashes alone
are joined first, and only documents with a hit are cut to windows with their tokens.  Matches are grouped by
document, item and alignment, never by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

WINDOW = 8
LITERAL = 4
ENOUGH = 6
BROADCAST_WINDOWS = 200_000

NAME, NUMBER, UNIT = "", "", ""
#: Units: fixed list, in lower case.
UNITS = "percent|%|€|\\$|£|km/h|km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|miles?|feet|foot|ft|inch(?:es)?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|cents?|euros?|pounds?|degrees?|°c|°f|mph|kwh|w|v|hz|gb|mb"
_BLANKS = " \t\n\u000b\f\r"
_NAMES = r"\p{Lu}(?<=[\p{Ll}\d,;] \p{Lu})[\p{L}\p{M}'’-]*"
_NUMBERS = r"\d+(?:[.,]\d+)*"
#: Numbers spelt out, from two on: a fixed list, by first letters.
_SPELT = r"(?<![\p{L}\d])(?:t(?:wo|hree|en|welve|hir(?:teen|ty)|wenty|housand)|f(?:our(?:teen)?|ive|if(?:teen|ty)|orty)|s(?:ix(?:teen|ty)?|even(?:teen|ty)?)|e(?:ight(?:een|y)?|leven)|nine(?:teen|ty)?|hundred|million|billion|dozen)(?![\p{L}\d])"
_UNITS = rf"(?<=[ -]?)(?:{UNITS})(?![\p{{L}}\d])"


def _tokens(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(_BLANKS)), r"[ \t-\r]+")


def canonical(text: Column) -> Column:
    """The text with typed placeholders, lower case; white space, and so the number of tokens, stays."""
    named = F.lower(F.regexp_replace(text, _NAMES, NAME))
    numbered = F.regexp_replace(F.regexp_replace(named, _NUMBERS, NUMBER), _SPELT, NUMBER)
    return F.when(F.contains(numbered, F.lit(NUMBER)), F.regexp_replace(numbered, _UNITS, UNIT)).otherwise(numbered)


def windows(rows: DataFrame, id_col: str, width: Column | int = WINDOW, raw: bool = False) -> DataFrame:
    """(id, place, width, hash, raw_hash, filled, template): every window of ``width`` tokens.

    The last two only if its text has placeholders, or ``raw``; the raw tokens' hash only if ``raw``.
    """
    # No filter on what the patterns give: it would be moved below them and run them once more.
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(id_col, text.alias("text"), canonical(text).alias("canon"))
    rows = rows.select(id_col, F.when(F.col("canon") != "", _tokens(F.col("canon"))).alias("canon"), (F.lit(raw) | F.col("canon").rlike("[-]")).alias("slotted"), "text")
    rows = rows.withColumn("width", width if isinstance(width, Column) else F.lit(width))
    places = F.when(F.size("canon") >= F.col("width"), F.sequence(F.lit(0), F.size("canon") - F.col("width")))
    rows = rows.select(id_col, "canon", "width", F.when(F.col("slotted"), _tokens(F.col("text"))).alias("raw"), F.explode_outer(places).alias("place")).where("place IS NOT NULL")
    cut = lambda c: F.slice(c, F.col("place") + 1, F.col("width"))
    raw_hash = F.xxhash64(cut(F.col("raw"))) if raw else F.lit(None).cast("long")
    return rows.select(id_col, "place", "width", F.xxhash64(cut(F.col("canon"))).alias("hash"), raw_hash.alias("raw_hash"), cut(F.col("raw")).alias("filled"), F.when(F.col("raw").isNotNull(), cut(F.col("canon"))).alias("template"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The contaminated (doc_id, item_id) pairs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL")
    items = items.where(F.btrim("text", F.lit(_BLANKS)) != "")
    placed = windows(items, "item_id", F.least(F.lit(WINDOW), F.size("canon")), raw=True)
    placeholder = lambda x: x.rlike("[-]")
    placed = placed.withColumn("exact", F.size(F.filter("template", lambda x: ~placeholder(x))) < LITERAL)
    known = placed.select("item_id", F.when(F.col("exact"), F.col("raw_hash")).otherwise(F.col("hash")).alias("hash"), "exact", "width", F.col("place").alias("item_place"), F.col("filled").alias("item_filled"), "template")
    per_item = known.groupBy("item_id").agg(F.countDistinct("item_place").alias("item_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("item_place"))).alias("item_rich"))
    known = known.join(per_item, "item_id")
    kinds = known.groupBy("width", "exact").count().collect()  # two rows a width at most
    few = sum(k["count"] for k in kinds) <= BROADCAST_WINDOWS
    if not few:
        # Hashes of 8 bytes meet first; the tokens of a window travel only for documents with a hit.
        touched = None
        for width in sorted({k["width"] for k in kinds}):
            keys = known.where(F.col("width") == width).select("hash").distinct()
            of_docs = windows(docs, "doc_id", width, raw=True).select("doc_id", F.explode(F.array("hash", "raw_hash")).alias("hash"))
            met = of_docs.distinct().join(keys, "hash").select("doc_id")
            touched = met if touched is None else touched.unionByName(met)
        docs = docs.join(materialise(touched.distinct(), "touched", narrow=True), "doc_id", "left_semi")
    hits = None
    for width in sorted({k["width"] for k in kinds} or {WINDOW}):
        mine = known.where(F.col("width") == width).drop("width")
        exact = any(k["exact"] for k in kinds if k["width"] == width)
        of_docs = windows(docs, "doc_id", width, raw=exact).select("doc_id", "place", "filled", "hash", "raw_hash")
        if exact:
            keys = F.array(F.struct(F.col("hash").alias("hash"), F.lit(False).alias("exact")), F.struct(F.col("raw_hash").alias("hash"), F.lit(True).alias("exact")))
            of_docs = of_docs.select("doc_id", "place", "filled", F.explode(keys).alias("key")).select("doc_id", "place", "filled", "key.hash", "key.exact")
        else:
            of_docs, mine = of_docs.drop("raw_hash"), mine.drop("exact").withColumn("exact", F.lit(False))
        met = of_docs.join(F.broadcast(mine) if few else mine, ["hash", "exact"] if exact else "hash")
        met = met.select("doc_id", "place", "filled", "exact", "item_id", "item_windows", "item_rich", "item_place", "item_filled", "template")
        hits = met if hits is None else hits.unionByName(met)
    hits = hits.select("doc_id", "item_id", "item_windows", "item_rich", "exact", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), "item_filled", "filled", "template")

    # Slot pairs of a window: (item's value, document's value) where the template has a placeholder.
    pairs = F.filter(F.zip_with(F.arrays_zip("item_filled", "filled"), "template", lambda v, t: F.when(placeholder(t), v)), lambda v: v.isNotNull())
    spread = hits.select("doc_id", "item_id", "item_windows", "item_rich", "exact", "shift", "item_place", F.explode_outer(F.when(F.col("template").isNotNull() & F.col("filled").isNotNull(), pairs)).alias("slot"))
    runs = spread.groupBy("doc_id", "item_id", "item_windows", "item_rich", "shift").agg(
        F.countDistinct("item_place").alias("n_windows"),
        F.countDistinct(F.when(~F.col("exact"), F.col("item_place"))).alias("n_rich"),
        F.countDistinct("slot").alias("n_pairs"),
        F.countDistinct("slot.item_filled").alias("n_values"),
        F.countDistinct(F.when(~F.col("exact"), F.col("slot"))).alias("rich_pairs"),
        F.countDistinct(F.when(~F.col("exact"), F.col("slot.item_filled"))).alias("rich_values"),
        F.max(F.coalesce(F.col("slot.item_filled") != F.col("slot.filled"), F.lit(False))).alias("reparameterised"),
    )
    least = lambda c: F.greatest(F.lit(1), F.least(F.lit(ENOUGH), F.ceil(F.col(c) / 2)))
    rich = (F.col("rich_pairs") == F.col("rich_values")) & (F.col("n_rich") >= least("item_rich"))
    whole = (F.col("n_pairs") == F.col("n_values")) & (F.col("n_windows") >= least("item_windows"))
    good = runs.where(rich | whole)
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "item_windows", "reparameterised")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_windows", F.col("m.item_windows").alias("item_windows"), F.col("m.reparameterised").alias("reparameterised"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns."""
    gone = find(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def _sql() -> str:
    """The same in DuckDB's SQL, whose patterns cannot look behind: names by the word before, the others by what is
    around them, twice, as a neighbour may be used up by the match before."""
    spelt = _SPELT.removeprefix(r"(?<![\p{L}\d])").removesuffix(r"(?![\p{L}\d])")
    name = r"^\p{Lu}[\p{L}\p{M}''’-]*"
    around, united = rf"(^|[^\p{{L}}\d]){spelt}([^\p{{L}}\d]|$)", rf"({NUMBER}[ -]?)(?:{UNITS})([^\p{{L}}\d]|$)"
    twice = lambda x, pattern, new: f"regexp_replace(regexp_replace({x}, '{pattern}', '\\1{new}\\2', 'g'), '{pattern}', '\\1{new}\\2', 'g')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    tokens = lambda x: f"string_split_regex(trim({x}, {blanks}), '[ \\t-\\r]+')"
    slot = lambda x: f"regexp_matches({x}, '[{NAME}{NUMBER}{UNIT}]')"
    least = lambda c: f"greatest(1, least({ENOUGH}, ceil({c} / 2.0)))"

    def cut(source: str) -> str:
        named = f"array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(w[i - 1], '[\\p{{Ll}}\\d,;]$') THEN regexp_replace(w[i], '{name}', '{NAME}') ELSE w[i] END), ' ')"
        numbered = twice(f"regexp_replace(lower({named}), '{_NUMBERS}', '{NUMBER}', 'g')", around, NUMBER)
        return f"""{source}_canon AS (SELECT id, text, {twice(numbered, united, UNIT)} AS canon FROM (SELECT id, text, string_split(text, ' ') AS w FROM {source})),
{source}_tokens AS (SELECT id, row_number() OVER () AS r, {tokens('canon')} AS c, {tokens('text')} AS t FROM {source}_canon WHERE canon <> '')"""

    return f"""WITH items AS (SELECT item_id AS id, text FROM benchmark WHERE item_id IS NOT NULL AND trim(text, {blanks}) <> ''), {cut('items')}, docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), {cut('docs')},
wide AS (SELECT id, c, t, least({WINDOW}, len(c)) AS width FROM items_tokens), placed AS (SELECT id AS item_id, width, i - 1 AS item_place, c[i:i + width - 1] AS c, t[i:i + width - 1] AS t FROM wide, unnest(range(1, len(c) - width + 2)) AS x(i)),
judged AS (SELECT *, len(list_filter(c, lambda x: NOT {slot('x')})) < {LITERAL} AS exact FROM placed),
known AS (SELECT *, CASE WHEN exact THEN 'r' || array_to_string(t, chr(31)) ELSE 'c' || array_to_string(c, chr(31)) END AS k FROM judged),
per_item AS (SELECT item_id, count(DISTINCT item_place) AS item_windows, count(DISTINCT CASE WHEN NOT exact THEN item_place END) AS item_rich FROM known GROUP BY item_id),
cuts AS (SELECT id AS doc_id, width, i - 1 AS place, c[i:i + width - 1] AS c, t[i:i + width - 1] AS t FROM docs_tokens, (SELECT DISTINCT width FROM known), unnest(range(1, len(c) - width + 2)) AS x(i) WHERE len(c) >= width),
keyed AS (SELECT doc_id, width, place, t, 'c' || array_to_string(c, chr(31)) AS k FROM cuts UNION ALL SELECT doc_id, width, place, t, 'r' || array_to_string(t, chr(31)) FROM cuts),
hits AS (SELECT doc_id, k.item_id, exact, item_place, place - item_place AS shift, k.c AS template, k.t AS was, d.t AS now FROM keyed d JOIN known k ON d.k = k.k AND d.width = k.width),
slots AS (SELECT doc_id, item_id, shift, exact, was[i] AS was, now[i] AS now FROM hits, unnest(range(1, len(template) + 1)) AS x(i) WHERE {slot('template[i]')}),
filled AS (SELECT doc_id, item_id, shift, count(DISTINCT (was, now)) AS n_pairs, count(DISTINCT was) AS n_values, count(DISTINCT (was, now)) FILTER (NOT exact) AS rich_pairs, count(DISTINCT was) FILTER (NOT exact) AS rich_values, max(was <> now) AS changed FROM slots GROUP BY ALL),
runs AS (SELECT doc_id, item_id, shift, count(DISTINCT item_place) AS n_windows, count(DISTINCT CASE WHEN NOT exact THEN item_place END) AS n_rich FROM hits GROUP BY ALL),
good AS (SELECT r.doc_id, r.item_id, n_windows, item_windows, coalesce(changed, false) AS reparameterised FROM runs r JOIN per_item p ON p.item_id = r.item_id LEFT JOIN filled f ON f.doc_id = r.doc_id AND f.item_id = r.item_id AND f.shift = r.shift
  WHERE (coalesce(rich_pairs, 0) = coalesce(rich_values, 0) AND n_rich >= {least('item_rich')}) OR (coalesce(n_pairs, 0) = coalesce(n_values, 0) AND n_windows >= {least('item_windows')}))
SELECT doc_id, item_id, n_windows, item_windows, reparameterised FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, item_windows DESC, reparameterised DESC) = 1"""


SQL = _sql()
