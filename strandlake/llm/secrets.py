"""Secret scans: fixed patterns, then a battery of randomness tests, in DataFrame functions only.

Base patterns (kinds ``assign``, ``access``, ``hex``) give leftmost non-overlapping matches per kind; short
ones are dropped after matching.  The method adds kind ``random``: tokens of 20 or more characters that
look drawn evenly from the alphabet of their inferred encoding (hex, base32, base36, base62, base64 and its
form for URLs) and overlap no base match.

Battery.  Three statistics of a token: chi-squared of its characters against an even draw, runs, and serial
correlation of neighbours in the alphabet.  Each is read twice:

* Against an even draw, as standard scores (runs about the alphabet's middle).  Their sum of squares T must
  not reject one: at most ``PASSES``, the 0.999 point of chi-squared with 3 degrees of freedom.
* Against ordinary tokens (identifiers, paths, slugs), for p-values.  The null is a fixed model, the same for
  every table: characters coincide as letters of running text do (``COINCIDE``), runs of one kind (digits,
  upper, lower case; separators and the capital of a word count for what they stand by) end with probability
  ``CHANGE``, and neighbours correlate by ``NEIGHBOURS`` or more.  Each statistic has a known mean and
  spread under it for every length.  Fisher's method makes one p-value of the three.

False-discovery control: the Benjamini-Hochberg step at ``RATE`` over the tokens of one text and length
class.  So the answer for a text depends on that text alone, whatever stands beside it in the table.

Measured (tests/llm): recall of even draws alone in their text at 24 characters at least 0.9 for hex, base32,
base36, base62 and base64, more with length; letters of both cases without any digit reach 0.9 from 28; of
22,000 identifiers and paths of Python's library 49 are reported.  Letters of one case without a digit have
no encoding here: three statistics cannot tell them from words.

Contract: one row per input row, repeated rows too.  Null and empty texts: counts 0, the digest of the
empty string, spans ''.  Positions are code points, end exclusive.  Spans are listed by start, then kind in
the order above.  Ties in p are decided alike.  Other columns are ignored.  Values never leave the task that
reads the text: only places, lengths and p-values are shuffled, once, by document and hash of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns.  Letters of the first are spelt in both cases, so that no engine folds other letters.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Length classes of tokens, by least length: the families of the false-discovery control.
CLASSES = (20, 24, 32, 48, 64, 96)
RATE = 0.01
PASSES = 16.27
#: Ordinary tokens: the chance that two characters, and three, are equal; wider for alphabets of 16.
COINCIDE, COINCIDE_16 = (0.0655, 0.0054), (0.115, 0.0165)
#: The chance that the kind of character changes, in alphabets of both cases and of one; spread of their number.
CHANGE, CHANGE_ONE, SPREAD = 0.05, 0.02, 1.5
NEIGHBOURS = 0.1
MARK = "[SECRET]"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _matches(text: Column, pattern: str, kind: int, group: int = 0, guard: str | None = None) -> Column:
    """array of (kind, k, gap before, length, value) of the pattern's matches; empty without any."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.zip_with(F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), value, lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")))
    rows = F.transform(found, lambda s, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), s["gap"].alias("gap"), s["size"].alias("size"), s["value"].alias("value")))
    return F.when(text.rlike(guard or pattern), F.filter(rows, lambda s: s["size"].isNotNull()))


def _encoding(token: Column) -> Column:
    """The alphabet of the inferred encoding, null for words, plain numbers and mixed separators."""
    has = lambda cls: token.rlike(cls)
    both = has("[a-z]") & has("[A-Z]")
    return (
        F.when(~has("[A-Za-z]") | ~has("[0-9]") & ~both | has("[_-]") & has("[+/]"), None)
        .when(~has("[^0-9a-f]"), F.lit(_DIGITS + "abcdef"))
        .when(~has("[^0-9A-F]"), F.lit(_DIGITS + "ABCDEF"))
        .when(~has("[^A-Z2-7]"), F.lit(_UPPER + "234567"))
        .when(~has("[^a-z0-9]"), F.lit(_DIGITS + _LOWER))
        .when(~has("[^A-Z0-9]"), F.lit(_DIGITS + _UPPER))
        .when(~has("[^A-Za-z0-9]"), F.lit(_DIGITS + _UPPER + _LOWER))
        .when(both, F.when(has("[_-]"), F.lit(_UPPER + _LOWER + _DIGITS + "-_")).otherwise(F.lit(_UPPER + _LOWER + _DIGITS + "+/")))
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _below(z: Column) -> Column:
    """The standard normal distribution function (a rational form of the error function, to 1e-7)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + x * 0.3275911)
    tail = t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592) * F.exp(-x * x) / 2
    return F.greatest(F.when(z > 0, 1 - tail).otherwise(tail), F.lit(1e-12))


def battery(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of ``rows`` (token, alphabet, ...), with ``t`` (against an even draw) and ``p`` (against
    ordinary tokens); both null without an alphabet."""
    have = F.col("alphabet").isNotNull()
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    kinds = F.regexp_replace(F.translate("token", _DIGITS + _UPPER + _LOWER + "+/_-", "D" * 10 + "U" * 26 + "L" * 26), "UL", "LL")
    kind_runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    rows = rows.select(*keep, "alphabet", F.when(have, chars).alias("chars"), F.when(have, F.length(kinds)).cast("double").alias("m"), F.when(have, kind_runs - 1).cast("double").alias("changes"))
    v = F.transform("chars", lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    equal = F.transform(F.array_distinct("chars"), lambda c: F.pow(F.size(F.filter("chars", lambda x: x == c)).cast("double"), F.lit(2)))
    high = F.transform("chars", lambda c: F.when((F.instr(F.col("alphabet"), c) - 1) * 2 >= F.length("alphabet"), 1.0).otherwise(0.0))
    rows = rows.select(*keep, "m", "changes", F.size("chars").cast("double").alias("n"), F.length("alphabet").cast("double").alias("a"), v.alias("v"), _sum(equal).alias("squares"), high.alias("high"))
    n, a = F.col("n"), F.col("a")
    pairs = lambda c, f: _sum(F.zip_with(F.slice(c, F.lit(1), F.size("v") - 1), F.slice(c, F.lit(2), F.size("v") - 1), f))
    rows = rows.select("*", (_sum(F.col("v")) / n).alias("mean"), _sum(F.col("high")).alias("n1"), (1 + pairs("high", lambda x, y: F.abs(x - y))).alias("runs"))
    var = _sum(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    rows = rows.select(*keep, "m", "changes", "n", "a", "squares", "n1", "runs", var.alias("var"), pairs("v", lambda x, y: (x - F.col("mean")) * (y - F.col("mean"))).alias("lagged"))

    # Against an even draw.
    both = 2 * F.col("n1") * (n - F.col("n1"))
    spread = both * (both - n) / (n * n * (n - 1))
    serial = F.when(F.col("var") > 0, F.col("lagged") / F.col("var") + 1 / n).otherwise(1.0)
    z1 = (F.col("squares") * a / n - n - a + 1) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    z2 = F.when(spread > 0, (F.col("runs") - both / n - 1) / F.sqrt(F.when(spread > 0, spread))).otherwise(F.sqrt(n))
    # Against ordinary tokens: few coincidences, many changes of kind, neighbours that do not correlate.
    few = a == 16
    s2, s3 = (F.when(few, F.lit(COINCIDE_16[k])).otherwise(F.lit(COINCIDE[k])) for k in (0, 1))
    drawn = n * (n - 1) / 2
    low = ((F.col("squares") - n) / 2 - drawn * s2) / F.sqrt(drawn * (s2 - s2 * s2 + 2 * (n - 2) * (s3 - s2 * s2)))
    change = F.when(a <= 36, F.lit(CHANGE_ONE)).otherwise(F.lit(CHANGE))
    many = (F.col("changes") - 0.5 - (F.col("m") - 1) * change) / F.sqrt(F.greatest(F.col("m") - 1, F.lit(1.0)) * change * (1 - change) * SPREAD)
    rows = rows.select(*keep, z1.alias("z1"), z2.alias("z2"), (serial * F.sqrt(n)).alias("z3"), (-F.log(_below(low)) - F.log(_below(-many)) - F.log(_below((serial - NEIGHBOURS) * F.sqrt(n)))).alias("x"))
    t = F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2") + F.col("z3") * F.col("z3")
    # Fisher: twice x is chi-squared with 6 degrees of freedom.
    return rows.select(*keep, t.alias("t"), (F.exp(-F.col("x")) * (1 + F.col("x") + F.col("x") * F.col("x") / 2)).alias("p"))


def _class(length: Column) -> Column:
    out = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        out = F.when(length >= c, F.lit(c)).otherwise(out)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, copies, kind, start, stop) of every span, and a row of nulls for a document without any.

    ``th`` is the text's hash, which tells apart rows that share an id; ``copies`` counts equal rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array()
    every = F.concat(
        F.coalesce(_matches(text, ASSIGN, 0, 2), none),
        # Long enough at once: what the plain pattern matches short holds no longer match.
        F.coalesce(_matches(text, ACCESS[:-1] + "{%d,}" % (LEAST["access"] - 4), 1), none),
        F.coalesce(_matches(text, HEX[:-1] + "{%d,}" % LEAST["hex"], 2), none),
        F.coalesce(_matches(text, TOKEN, 3), none),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode_outer(every).alias("m")).select("doc_id", "th", "m.*")
    least = F.when(F.col("kind") == 0, F.length("value") >= LEAST["assign"]).otherwise(F.col("kind").isNotNull())
    place = ["doc_id", "th", "kind", "k", "gap", "size", "good"]
    rows = rows.withColumn("good", least).withColumn("token", F.when(F.col("kind") == 3, F.col("value")))
    rows = battery(rows.withColumn("alphabet", _encoding(F.col("token"))), place)
    rows = rows.withColumn("even", F.col("t") <= PASSES).drop("t")
    # One exchange: all that follows is by (doc_id, th).
    rows = rows.repartition("doc_id", "th").groupBy(*place, "p", "even").agg(F.count("*").alias("copies"))
    run = Window.partitionBy("doc_id", "th", "kind").orderBy("k")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("stop") - F.col("size"))

    # A token goes if a base match overlaps it: one that starts no later and ends after its start, or one
    # that starts inside it.
    base = (F.col("kind") < 3) & F.col("good")
    rows = rows.withColumn("base_stop", F.when(base, F.col("stop"))).withColumn("base_start", F.when(base, F.col("start")))
    upto = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    clear = (F.coalesce(F.max("base_stop").over(upto), F.lit(-1)) <= F.col("start")) & (F.coalesce(F.min("base_start").over(onward), F.col("stop")) >= F.col("stop"))
    rows = rows.withColumn("clear", (F.col("kind") == 3) & clear)
    # The family of a p-value: clear tokens of the text's length class; those that are not even count in it.
    family = Window.partitionBy("doc_id", "th", "class")
    rows = rows.withColumn("class", F.when(F.col("clear") & F.col("p").isNotNull(), _class(F.col("size"))))
    rows = rows.withColumn("tokens", F.count("*").over(family)).withColumn("even_p", F.when(F.col("even"), F.col("p")))
    rows = rows.withColumn("rank", F.count("even_p").over(family.orderBy(F.col("even_p").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("cut", F.max(F.when(F.col("even_p") * F.col("tokens") <= RATE * F.col("rank"), F.col("even_p"))).over(family))
    found = F.when(F.col("class").isNotNull(), F.coalesce(F.col("even_p") <= F.col("cut"), F.lit(False))).otherwise(base)
    return rows.select("doc_id", "th", "copies", *[F.when(found, F.col(c)).alias(c) for c in ("kind", "start", "stop")])


def _joined(most: int) -> Column:
    """kind:start:end of kinds below ``most``, by start, then kind."""
    listed = F.sort_array(F.collect_list(F.when(F.col("kind") < most, F.struct("start", "kind", "stop"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = spans(docs, id_col, text_col).groupBy("doc_id", "th").agg(F.max("copies").alias("copies"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], _joined(3).alias("base"), _joined(4).alias("spans"))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans").hint("rebalance")


def _matches_sql(kind: int, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, unnest(regexp_extract_all(text, '{p}')) AS whole, unnest(regexp_extract_all(text, '{p}', {group})) AS value, unnest(list_transform(string_split_regex(text, '{p}')[:-2], lambda x: length(x))) AS gap, unnest(range(len(regexp_extract_all(text, '{p}')))) AS k FROM texts WHERE regexp_matches(text, '{p}')"""


def _below_sql(z: str) -> str:
    t = f"(1 / (1 + abs({z}) / sqrt(2) * 0.3275911))"
    tail = f"({t} * ({t} * ({t} * ({t} * ({t} * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592) * exp(-({z}) * ({z}) / 2) / 2)"
    return f"greatest(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END, 1e-12)"


def _sql() -> str:
    """The same in DuckDB's SQL: plain match places, then the battery's formulas over lists of characters."""
    has = lambda cls: f"regexp_matches(token, '{cls}')"
    both = f"({has('[a-z]')} AND {has('[A-Z]')})"
    alphabet = f"""CASE WHEN NOT {has('[A-Za-z]')} OR (NOT {has('[0-9]')} AND NOT {both}) OR ({has('[_-]')} AND {has('[+/]')}) THEN NULL
  WHEN NOT {has('[^0-9a-f]')} THEN '{_DIGITS}abcdef' WHEN NOT {has('[^0-9A-F]')} THEN '{_DIGITS}ABCDEF' WHEN NOT {has('[^A-Z2-7]')} THEN '{_UPPER}234567' WHEN NOT {has('[^a-z0-9]')} THEN '{_DIGITS}{_LOWER}'
  WHEN NOT {has('[^A-Z0-9]')} THEN '{_DIGITS}{_UPPER}' WHEN NOT {has('[^A-Za-z0-9]')} THEN '{_DIGITS}{_UPPER}{_LOWER}' WHEN {both} THEN CASE WHEN {has('[_-]')} THEN '{_UPPER}{_LOWER}{_DIGITS}-_' ELSE '{_UPPER}{_LOWER}{_DIGITS}+/' END END"""
    kinds = f"regexp_replace(translate(token, '{_DIGITS + _UPPER + _LOWER}', '{'D' * 10 + 'U' * 26 + 'L' * 26}'), '[+/_-]', '', 'g')"
    s2, s3 = (f"CASE WHEN a = 16 THEN {COINCIDE_16[k]!r}::DOUBLE ELSE {COINCIDE[k]!r}::DOUBLE END" for k in (0, 1))
    change = f"CASE WHEN a <= 36 THEN {CHANGE_ONE!r}::DOUBLE ELSE {CHANGE!r}::DOUBLE END"
    least = "CASE kind WHEN 0 THEN length(value) >= 8 WHEN 1 THEN length(whole) >= 16 WHEN 2 THEN length(whole) >= 32 ELSE true END"
    cls = "CASE " + " ".join(f"WHEN stop - start >= {c} THEN {c}" for c in reversed(CLASSES)) + " END"
    name = f"{list(KINDS)}"
    listed = lambda most: f"coalesce(string_agg({name}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {most}), '')"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_matches_sql(0, ASSIGN, 2)} UNION ALL {_matches_sql(1, ACCESS)} UNION ALL {_matches_sql(2, HEX)} UNION ALL {_matches_sql(3, TOKEN)}),
placed AS (SELECT doc_id, kind, whole, value, CAST(sum(gap + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS stop FROM found),
good AS (SELECT doc_id, kind, stop - length(whole) AS start, stop, whole AS token FROM placed WHERE {least}),
clear AS (SELECT * FROM good t WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM good b WHERE b.doc_id = t.doc_id AND b.kind < 3 AND b.start < t.stop AND b.stop > t.start)),
encoded AS (SELECT * FROM (SELECT *, {alphabet} AS alphabet FROM clear) WHERE alphabet IS NOT NULL),
spelt AS (SELECT doc_id, start, stop, length(alphabet)::DOUBLE AS a, (stop - start)::DOUBLE AS n, string_split(token, '') AS c, list_transform(string_split(token, ''), lambda x: (strpos(alphabet, x) - 1)::DOUBLE) AS v, string_split(replace({kinds}, 'UL', 'LL'), '') AS kinds FROM encoded),
counted AS (SELECT *, list_sum(list_transform(list_distinct(c), lambda x: pow(len(list_filter(c, lambda y: y = x)), 2))) AS squares, list_sum(v) / n AS mean, list_sum(list_transform(v, lambda x: CASE WHEN x * 2 >= a THEN 1.0 ELSE 0.0 END)) AS n1,
  1 + list_sum(list_transform(range(1, len(v)), lambda i: CASE WHEN (v[i] * 2 >= a) <> (v[i + 1] * 2 >= a) THEN 1.0 ELSE 0.0 END)) AS runs, len(kinds)::DOUBLE AS m, coalesce(list_sum(list_transform(range(1, len(kinds)), lambda i: CASE WHEN kinds[i] <> kinds[i + 1] THEN 1.0 ELSE 0.0 END)), 0) AS changes FROM spelt),
spread AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) AS var, list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))) AS lagged, 2 * n1 * (n - n1) AS twice, n * (n - 1) / 2 AS pairs, {s2} AS s2, {s3} AS s3, {change} AS change FROM counted),
scored AS (SELECT *, CASE WHEN var > 0 THEN lagged / var + 1 / n ELSE 1.0 END AS serial, (squares * a / n - n - a + 1) / sqrt(2 * (a - 1) * (n - 1) / n) AS z1, CASE WHEN twice * (twice - n) > 0 THEN (runs - twice / n - 1) / sqrt(twice * (twice - n) / (n * n * (n - 1))) ELSE sqrt(n) END AS z2,
  ((squares - n) / 2 - pairs * s2) / sqrt(pairs * (s2 - s2 * s2 + 2 * (n - 2) * (s3 - s2 * s2))) AS low, (changes - 0.5 - (m - 1) * change) / sqrt(greatest(m - 1, 1.0) * change * (1 - change) * {SPREAD}) AS many FROM spread),
tested AS (SELECT *, z1 * z1 + z2 * z2 + serial * serial * n AS t, -ln({_below_sql('low')}) - ln({_below_sql('(-many)')}) - ln({_below_sql(f'((serial - {NEIGHBOURS}) * sqrt(n))')}) AS x, {cls} AS class FROM scored),
families AS (SELECT *, exp(-x) * (1 + x + x * x / 2) AS p, t <= {PASSES} AS even FROM tested),
ranked AS (SELECT *, count(*) OVER (PARTITION BY doc_id, class) AS tokens, CASE WHEN even THEN p END AS even_p, count(*) FILTER (even) OVER (PARTITION BY doc_id, class ORDER BY p RANGE UNBOUNDED PRECEDING) AS rank FROM families),
cuts AS (SELECT *, max(CASE WHEN even_p * tokens <= {RATE} * rank THEN even_p END) OVER (PARTITION BY doc_id, class) AS cut FROM ranked),
every AS (SELECT doc_id, kind, start, stop FROM good WHERE kind < 3 UNION ALL SELECT doc_id, 3, start, stop FROM cuts WHERE even_p <= cut)
SELECT t.doc_id, {', '.join(f'count(*) FILTER (kind = {i}) AS n_{k}' for i, k in enumerate(KINDS))}, sha256({listed(3)}) AS base_sha256, {listed(4)} AS spans FROM texts t LEFT JOIN every e ON e.doc_id = t.doc_id GROUP BY t.doc_id"""


SQL = _sql()


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with every span, overlapping ones merged, replaced by ``MARK``."""
    found = spans(docs).where("kind IS NOT NULL")
    by = Window.partitionBy("doc_id", "th").orderBy("start", "stop")
    found = found.withColumn("before", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("island", F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(by))
    found = found.groupBy("doc_id", "th", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    lists = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")).select(F.col("doc_id").alias("cut_id"), "th", "cuts")
    # The columns travel under names of their own, so that none of the input's can clash.
    names = docs.columns
    held = docs.toDF(*[f"column_{i}" for i in range(len(names))])
    doc, text = (F.col(f"column_{names.index(c)}") for c in ("doc_id", "text"))
    place = held.withColumn("th_of", F.xxhash64(text.cast("string"))).join(lists, doc.cast("long").eqNullSafe(F.col("cut_id")) & (F.col("th_of") == F.col("th")), "left")
    # The end of one span to the start of the next is what stays.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.stop"))
    begins = F.concat(F.col("cuts.start"), F.array(F.length(text).cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda s: F.substring(text, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))
    redacted = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, MARK))
    return place.select(*[(redacted if c == "text" else F.col(f"column_{i}")).alias(c) for i, c in enumerate(names)])
