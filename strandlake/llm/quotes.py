"""Quotation linking: conversations in reply order, without quotes.

Each message is parsed to passages: runs of lines of one quote level (the number of leading ``>`` marks,
blanks between them allowed); a line that introduces a quote ("... wrote:") belongs to it.  A passage, quoted or
own, is normalised: marks off, lines put together, white space squeezed, lower case; so a quote that was
wrapped anew is the same passage.  It is hashed whole, by paragraph, and by sentence of ``LEAST_WORDS`` words or
more, as quotes are cut; the hashes are joined, within the conversation, to those of what its messages
hold outside quotes.  A message replies to the latest earlier message that holds most words of what it quotes at
level 1 (deeper levels only count if level 1 finds nothing), so a passage outweighs a line that many messages
share; without a quote that links, to the turn before it, if there is one.

Contract: one row per input row: conv_id, turn, role, text (the message without quotes), n_quotes (passages),
n_linked (quoted passages of which something was found), reply_to (turn, null at a root), thread (the turn of its root), depth.
Ordering a conversation by (thread, depth, turn) gives every reply after what it answers.  A null
text is empty and stays null; empty messages stay.  Rows that repeat a (conv_id, turn) each stay; links
go by turn.  A null conv_id or turn links with nothing.  Other columns are ignored.

Only hashes of passages and their parts are shuffled, keyed by conversation and hash, and a quoted one is looked up
once a conversation, however often it is quoted.  Roots come by pointer doubling, so a hot conversation of n turns
takes log2(n) rounds of joins on (conv_id, turn), never one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

#: Words of a sentence that is hashed for itself.
LEAST_WORDS = 4
_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.I)


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(quote level, lines without marks) of each run of lines of one level."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line[m.end() :] if m else line)
    return out


_SENTENCE = re.compile(r"(?<=[.!?]) ")


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def units(lines: list[str]) -> dict[int, int]:
    """hash -> words, of the passage that ``lines`` make, of its paragraphs and of its longer sentences."""
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        words = line.lower().split()
        if words:
            paragraphs[-1] += words
        elif paragraphs[-1]:
            paragraphs.append([])
    texts = [" ".join(p) for p in paragraphs if p]
    out = {_hash(t): t.count(" ") + 1 for t in (*texts, " ".join(texts)) if t}
    for t in texts:
        for x in _SENTENCE.split(t):
            if x.count(" ") + 1 >= LEAST_WORDS:
                out[_hash(x)] = x.count(" ") + 1
    return out


def split_message(text: str) -> tuple[str, list[tuple[int, dict[int, int]]], set[int]]:
    """(text outside quotes, (level, units) of each quoted passage, hashes of what the message holds itself)."""
    parts = passages(text)
    own, quoted, held = [], [], set()
    for k, (level, lines) in enumerate(parts):
        if level:
            quoted.append((level, units(lines)))
            continue
        follows = k + 1 < len(parts)
        filled = [i for i, x in enumerate(lines) if x.strip()]
        if follows and filled and _INTRO.search(lines[filled[-1]]):
            lines = lines[: filled[-1]]
        own.append("\n".join(lines))
        held |= units(lines).keys()
    held |= units("\n".join(own).split("\n")).keys()
    return ("\n".join(own).strip("\n") if quoted else text), quoted, held


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("unit", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        text, n, quotes, lines = [], [], [], []
        for t in batch["text"].to_pylist():
            own, quoted, held = split_message(t or "")
            text.append(None if t is None else own)
            n.append(len(quoted))
            quotes.append([{"passage": k, "level": level, "unit": h, "words": w} for k, (level, found) in enumerate(quoted) for h, w in found.items()])
            lines.append(sorted(held))
        yield pa.record_batch([batch["conv_id"], batch["turn"], batch["role"], pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(quotes, kind), pa.array(lines, pa.list_(pa.int64()))], ["conv_id", "turn", "role", "text", "n_quotes", "quotes", "units"])


def link(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of messages that quote, and the parsed messages."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = materialise(rows.mapInArrow(_parse, "conv_id long, turn long, role string, text string, n_quotes long, quotes array<struct<passage:int,level:int,unit:long,words:long>>, units array<long>"), "messages")
    quoted = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    wanted = quoted.select("conv_id", "unit").distinct()
    held = parsed.select("conv_id", F.col("turn").alias("source"), F.explode("units").alias("unit")).join(wanted, ["conv_id", "unit"], "left_semi").distinct()
    # The latest source before the quoting turn: sources and quotes of one key, sorted once, latest so far.
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = held.select("conv_id", "unit", F.col("source").alias("at"), F.lit(1).alias("own"), none("passage", "int"), none("level", "int"), none("words", "long")).unionByName(quoted.select("conv_id", "unit", F.col("turn").alias("at"), F.lit(0).alias("own"), "passage", "level", "words"))
    before = Window.partitionBy("conv_id", "unit").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.max(F.when(F.col("own") == 1, F.col("at"))).over(before)).where("own = 0 AND source IS NOT NULL")
    votes = found.groupBy("conv_id", F.col("at").alias("turn"), "source").agg(F.sum(F.when(F.col("level") == 1, F.col("words")).otherwise(0)).alias("near"), F.sum("words").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("near", "n", "source")).alias("m"))
    linked = found.groupBy("conv_id", F.col("at").alias("turn")).agg(F.countDistinct("passage").alias("n_linked"))
    return parsed, best.join(linked, ["conv_id", "turn"]).select("conv_id", "turn", F.col("m.source").alias("quoted_turn"), "n_linked")


def reply_order(conversations: DataFrame) -> DataFrame:
    """Every message without quotes, with its place in the conversation's reply trees."""
    parsed, linked = link(conversations)
    turns = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    previous = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    parent = turns.join(linked, ["conv_id", "turn"], "left").join(previous, ["conv_id", "turn"], "left")
    parent = parent.select("conv_id", "turn", F.coalesce("quoted_turn", F.when(F.col("follows"), F.col("turn") - 1)).alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    parent = materialise(parent, "parents", narrow=True)
    # Pointer doubling: (up, far) is the ancestor 2**k levels up, or the root (far counts the levels).  A
    # message whose pointer has met its root stays as it is; only the others are looked up again.
    jump = parent.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("reply_to").isNull().alias("done"))
    while True:
        jump = materialise(jump, "jump", narrow=True)
        if jump.where("NOT done").isEmpty():
            break
        up = jump.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = jump.where("NOT done").join(up, ["conv_id", "up"]).select("conv_id", "turn", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        jump = jump.where("done").unionByName(moved)
    placed = parent.join(jump.select("conv_id", "turn", F.col("up").alias("thread"), F.col("far").alias("depth")), ["conv_id", "turn"])
    return parsed.join(placed, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _units_sql(name: str, source: str, keys: str) -> str:
    """``name`` (keys, unit, words): the whole, the paragraphs and the longer sentences of ``source`` (keys, lines: a list)."""
    blank = r"regexp_matches(x, '^\s*$')"
    joined = rf"trim(regexp_replace(lower(array_to_string(l, ' ')), '\s+', ' ', 'g'))"
    return f"""{name}_flat AS (SELECT {keys}, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM {source}),
{name}_marked AS (SELECT *, sum(CASE WHEN {blank} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS paragraph FROM {name}_flat),
{name}_lists AS (SELECT {keys}, paragraph, list(x ORDER BY i) AS l FROM {name}_marked WHERE NOT {blank} GROUP BY ALL),
{name}_texts AS (SELECT {keys}, paragraph, {joined} AS t FROM {name}_lists),
{name} AS (SELECT DISTINCT {keys}, unit, len(string_split(unit, ' ')) AS words FROM (
  SELECT {keys}, t AS unit FROM {name}_texts UNION ALL SELECT {keys}, string_agg(t, ' ' ORDER BY paragraph) FROM {name}_texts GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT {keys}, unnest(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS unit FROM {name}_texts) WHERE len(string_split(unit, ' ')) >= {LEAST_WORDS}) WHERE unit <> '')"""


_MARK_SQL = r"^[ \t]*(?:>[ \t]?)+"
_INTRO_SQL = "(?i)" + _INTRO.pattern
#: Rows get a number, as they may repeat a (conv_id, turn).
SQL = rf"""WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, * FROM conversations), split AS (SELECT r, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM given),
levelled AS (SELECT *, length(m) - length(replace(m, '>', '')) AS level, substr(line, length(m) + 1) AS rest FROM (SELECT *, regexp_extract(line, '{_MARK_SQL}') AS m FROM split)),
opened AS (SELECT *, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS opens FROM levelled WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS p FROM opened),
runs AS (SELECT r, p, any_value(level) AS level, list(rest ORDER BY i) AS lines, max(i) FILTER (NOT regexp_matches(rest, '^\s*$')) AS filled, min(i) AS first, max(p) OVER (PARTITION BY r) AS last FROM numbered GROUP BY r, p),
cut AS (SELECT r, p, level, CASE WHEN level = 0 AND p < last AND filled IS NOT NULL AND regexp_matches(lines[filled - first + 1], '{_INTRO_SQL}') THEN lines[:filled - first] ELSE lines END AS lines FROM runs),
bodies AS (SELECT r, string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY p) FILTER (level = 0) AS body, count(*) FILTER (level > 0) AS n_quotes FROM cut GROUP BY r),
owned AS (SELECT r, lines FROM cut WHERE level = 0 UNION ALL SELECT r, string_split(body, chr(10)) FROM bodies WHERE body IS NOT NULL), owned_ids AS (SELECT row_number() OVER () AS o, r, lines FROM owned),
cited AS (SELECT r, p, level, lines FROM cut WHERE level > 0), {_units_sql('held', 'owned_ids', 'o, r')}, {_units_sql('quoted', 'cited', 'r, p, level')},
sources AS (SELECT DISTINCT g.conv_id, g.turn, unit FROM held JOIN given g USING (r) WHERE g.turn IS NOT NULL AND g.conv_id IS NOT NULL), quotes_ AS (SELECT DISTINCT g.conv_id, g.turn, p, level, unit, words FROM quoted JOIN given g USING (r) WHERE g.turn IS NOT NULL AND g.conv_id IS NOT NULL),
found AS (SELECT q.conv_id, q.turn, q.p, q.level, q.words, s.turn AS source FROM quotes_ q ASOF JOIN sources s ON s.conv_id = q.conv_id AND s.unit = q.unit AND q.turn > s.turn),
votes AS (SELECT conv_id, turn, source, sum(CASE WHEN level = 1 THEN words ELSE 0 END) AS near, sum(words) AS n FROM found GROUP BY ALL),
best AS (SELECT conv_id, turn, source FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY near DESC, n DESC, source DESC) = 1), linked AS (SELECT conv_id, turn, count(DISTINCT p) AS n_linked FROM found GROUP BY ALL),
turns AS (SELECT DISTINCT conv_id, turn FROM given WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
parents AS (SELECT t.conv_id, t.turn, coalesce(b.source, f.turn) AS reply_to, coalesce(n_linked, 0) AS n_linked FROM turns t LEFT JOIN best b ON b.conv_id = t.conv_id AND b.turn = t.turn LEFT JOIN linked l ON l.conv_id = t.conv_id AND l.turn = t.turn LEFT JOIN turns f ON f.conv_id = t.conv_id AND f.turn = t.turn - 1),
tree AS (SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM parents WHERE reply_to IS NULL UNION ALL SELECT c.conv_id, c.turn, t.thread, t.depth + 1 FROM tree t JOIN parents c ON c.conv_id = t.conv_id AND c.reply_to = t.turn)
SELECT g.conv_id, g.turn, g.role, CASE WHEN g.text IS NULL THEN NULL WHEN n_quotes > 0 THEN trim(coalesce(body, ''), chr(10)) ELSE g.text END AS text, n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to, coalesce(thread, g.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth
FROM given g JOIN bodies b USING (r) LEFT JOIN parents p ON p.conv_id = g.conv_id AND p.turn = g.turn LEFT JOIN tree t ON t.conv_id = g.conv_id AND t.turn = g.turn"""


def brute_force(rows: list[tuple[int | None, int | None, str, str | None]]) -> list[tuple[int | None, int | None, int | None, int]]:
    """(conv_id, turn, reply_to, n_linked) of each row by plain loops over the conversation, for tests."""
    parsed = [(c, t, *split_message(text or "")) for c, t, _, text in rows]
    out = []
    for c, t, _, _, _ in parsed:
        votes: dict[int, list[int]] = {}
        found = set()
        passages_of = {(k, level, h, w) for c2, t2, _, quoted, _ in parsed if (c2, t2) == (c, t) for k, (level, us) in enumerate(quoted) for h, w in us.items()}
        for k, level, h, w in passages_of if c is not None and t is not None else ():
            sources = [t2 for c2, t2, _, _, held in parsed if c2 == c and t2 is not None and t2 < t and h in held]
            if sources:
                v = votes.setdefault(max(sources), [0, 0])
                v[0], v[1] = v[0] + (w if level == 1 else 0), v[1] + w
                found.add(k)
        best = max(((*v, source) for source, v in votes.items()), default=None)
        before = c is not None and t is not None and any((c2, t2) == (c, t - 1) for c2, t2, *_ in parsed)
        out.append((c, t, best[2] if best else t - 1 if before else None, len(found)))
    return out
