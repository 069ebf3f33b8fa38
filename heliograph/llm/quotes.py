"""Quotation linking: messages that quote others become reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` marks before its text.  A run of lines of
one level above zero is a quoted passage; what remains is the message's own text, less
a line that only announces a quote ("... wrote:").  Passages are normalised (A-Z
lower-cased, ASCII white space collapsed) and hashed.  A message can be quoted by its whole
own text, by a paragraph of it or by a line of it, so each of these is hashed too; an
index keeps one row per hash, the earliest message with it.  A passage that is found as a whole
outranks single lines of a passage; a shallower one outranks a deeper one.

Only messages with a quote mark are parsed line by line, once; the parts of all others
are split and hashed by DataFrame functions, and only if there is any quote.

A quote is looked for in its own conversation first, among earlier turns.  Passages of
``min_words`` words or more that are not found there are looked for in the whole table,
first among messages that stand before the quoting one by (conv_id, turn).  Those links go
back only, so they form trees.  A message still without a link may point forward, into
another tree than its own, if that tree's top stands before it or points nowhere; so no
links ever form a ring.  Threads are resolved by pointer jumping over the linked messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import extended, read, tidy, without
from heliograph.storage import Scratch, join_checked

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ANNOUNCES = re.compile(r"(?i)^\s*(on\b.*|[^\s].*)\bwrote:\s*$")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

QUOTE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("words", T.IntegerType())])


SPACE = r"[ \t\n\x0B\f\r]+"


def normalised(text: str) -> str:
    return " ".join(x for x in re.split(SPACE, text.translate(_UPPER)) if x)


def normal_column(text: Column) -> Column:
    """``normalised`` as a column."""
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SPACE, " "))


def key_of(text: str) -> int:
    return int(np.array([xxhash.xxh64_intdigest(text.encode(), 42)], np.uint64).view(np.int64)[0])


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, quoted passage)]) of a message; a null text is an empty one."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if last == 0 and own and _ANNOUNCES.match(own[-1]):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip("\n") if passages else (text or ""), [(n, "\n".join(ls)) for n, ls in passages]


def _keys(text: str) -> tuple[int, int] | None:
    clean = normalised(text)
    return (key_of(clean), len(clean.split())) if clean else None


def _units(own: Column) -> Column:
    """The keys of a text's parts, as ``key_of`` gives them (XXH64 with Spark's own seed, 42), with their words."""
    parts = F.array_distinct(F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n")))
    clean = F.filter(F.array_distinct(F.transform(parts, normal_column)), lambda x: x != "")
    return F.transform(clean, lambda x: F.struct(F.xxhash64(x).alias("key"), F.size(F.split(x, " ")).alias("words")))


def _quotes(passages: list[tuple[int, str]]) -> list[tuple[int, int, int, int]]:
    """part 0: a whole passage; 1: a line of it."""
    out = set()
    for level, text in passages:
        out |= {(level, part, *k) for part, ts in ((0, [text]), (1, text.split("\n"))) for k in map(_keys, ts) if k}
    return sorted(out)


def _parsed(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [pa.string(), to_arrow_type(T.ArrayType(QUOTE)), pa.int64()]
        for batch in batches:
            rows = []
            for t in batch.column(batch.schema.names.index(text)).to_pylist():
                own, passages = parse(t)
                quotes = [{"level": n, "part": p, "key": k, "words": w} for n, p, k, w in _quotes(passages)]
                rows.append((own, quotes, len(passages)))
            own = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "__own", "__quotes", "n_quotes"])

    return run


def _without_rings(links: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """The links (me, m, parent) without that of each ring's earliest message.

    Every message has one link at most.  Pointers double each round; who reaches a message
    without a link is out.  After as many rounds as the rest has binary digits, the rest's
    pointers lead to all messages on rings, and each of these has seen its whole ring.
    """
    walk = scratch.table(links.select("m", F.col("parent").alias("to"), F.col("me").alias("low")), "walk0")
    left, k = walk.count(), 0
    while left and (1 << k) < 2 * left:
        if k >= max_rounds:
            raise RuntimeError(f"rings did not show in {max_rounds} rounds")
        on = walk.select(F.col("m").alias("um"), F.col("to").alias("uto"), F.col("low").alias("ulow"))
        k += 1
        walk = scratch.table(walk.join(on, F.col("to.m") == F.col("um")).select("m", F.col("uto").alias("to"), F.least("low", "ulow").alias("low")), f"walk{k}")
        scratch.drop(f"walk{k - 1}")
        left = walk.count()
    if not left:
        return links
    rings = scratch.table(walk.select(F.col("to.m").alias("m")).distinct().join(walk.select("m", F.col("low.m").alias("cut")), "m").select("cut").distinct(), "rings")
    return join_checked(links, rings, F.col("m") == F.col("cut"), "left_anti")


OUT = ("message_id", "thread_conv", "thread_turn", "reply_depth", "parent_conv", "parent_turn", "n_quotes")


def _resolved(edges: DataFrame, scratch: Scratch, label: str, max_rounds: int) -> DataFrame:
    """(m, parent, top, depth) by pointer jumping over the linked messages (m, parent), which form no ring."""
    found = scratch.table(edges.select("m", "parent", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")), f"{label}0")
    for k in range(1, max_rounds + 1):
        up = found.select(F.col("m").alias("um"), F.col("top").alias("utop"), F.col("depth").alias("ud"))
        jumped = found.join(up, F.col("top.m") == F.col("um"), "left")
        jumped = jumped.select("m", "parent", F.coalesce("utop", "top").alias("top"), (F.col("depth") + F.coalesce("ud", F.lit(0))).alias("depth"), F.col("um").isNotNull().alias("moved"))
        found = scratch.table(jumped, f"{label}{k}")
        if not found.where("moved").limit(1).count():
            return found
    raise RuntimeError(f"threads did not settle in {max_rounds} rounds")


def link_quotes(messages: DataFrame, *, min_words: int = 3, keep_unlinked: bool = True, conv: str = "conv_id", turn: str = "turn", text: str = "text", max_rounds: int = 60) -> DataFrame:
    """``messages`` without their quotes, plus message_id, thread_conv, thread_turn, reply_depth, parent_conv, parent_turn and n_quotes.

    Ordered by (thread_conv, thread_turn, reply_depth, turn), every message comes after
    the one it replies to.  A message without a found quote starts its own thread at
    depth 0; it keeps its text whole, since what it marks is no quote of the table's, or
    loses its marked lines too if ``keep_unlinked`` is false.  Null texts become empty;
    messages without a conversation or turn quote nothing and are never quoted; repeated
    rows share an id and a place; very long texts are parsed whole; an empty table stays
    empty; input columns named like the outputs are replaced.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    base = without(messages, *OUT, "__own", "__quotes", "__linked")
    fields = [T.StructField("__own", T.StringType()), T.StructField("__quotes", T.ArrayType(QUOTE)), T.StructField("n_quotes", T.LongType())]
    marked = F.coalesce(F.col(text).rlike(r"(?m)^[ \t]*>"), F.lit(False))
    parsed = scratch.table(base.where(marked).mapInArrow(tidy(_parsed(text)), extended(base, *fields)), "parsed")
    plain = base.where(~marked).withColumns({"__own": F.coalesce(text, F.lit("")), "__quotes": F.lit(None).cast(T.ArrayType(QUOTE)), "n_quotes": F.lit(0).cast("long")})
    number = F.xxhash64(conv, turn, text)
    whole = plain.unionByName(parsed).withColumn("message_id", number)
    at = F.struct(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col("message_id").alias("m"))
    named = F.col(conv).isNotNull() & F.col(turn).isNotNull()
    quotes = scratch.table(parsed.withColumn("message_id", number).where(named).select(at.alias("me"), F.explode("__quotes").alias("q")).select("me", "q.*"), "quotes")
    found = None
    if quotes.limit(1).count():
        asked = scratch.table(quotes.select("key").distinct(), "asked")
        units = whole.where(named).select(at.alias("of"), F.explode(_units(F.col("__own"))).alias("u")).select("of", "u.key", "u.words")
        units = scratch.table(join_checked(units, asked, "key", "left_semi"), "units")
        near = units.groupBy(F.col("of.c").alias("c"), "key").agg(F.min("of").alias("of"), F.max("words").alias("words"))
        near = scratch.table(near, "near")
        inside = quotes.withColumn("c", F.col("me.c")).join(near.drop("words"), ["c", "key"], "left").where(F.col("of.t") < F.col("me.t"))
        # the earliest message with these words, and for those who ask in its own conversation the earliest one of another
        common = near.where(F.col("words") >= min_words)
        first = common.groupBy("key").agg(F.min("of").alias("first"))
        second = common.join(first, "key").where(F.col("of.c") != F.col("first.c")).groupBy("key").agg(F.min("of").alias("second"))
        far = quotes.join(first, "key").join(second, "key", "left")
        far = far.withColumn("of", F.when(F.col("first.c") != F.col("me.c"), F.col("first")).otherwise(F.col("second"))).where("of is not null")
        rank = lambda own: F.struct(own.alias("far"), "level", "part", "of")
        every = inside.select("me", rank(F.lit(0)).alias("r")).unionByName(far.select("me", rank(F.when(F.col("of") < F.col("me"), 1).otherwise(2)).alias("r")))
        links = every.groupBy("me").agg(F.min("r").alias("r")).select("me", F.col("me.m").alias("m"), F.col("r.of").alias("parent"))
        found = _resolved(_without_rings(scratch.table(links, "links"), scratch, max_rounds), scratch, "round", max_rounds)
    if found is None:
        nothing = F.lit(None)
        out = whole.withColumns({"parent_conv": nothing.cast(base.schema[conv].dataType), "parent_turn": nothing.cast(base.schema[turn].dataType), "thread_conv": F.col(conv), "thread_turn": F.col(turn), "reply_depth": F.lit(0).cast("long"), "__linked": F.lit(False)})
    else:
        joined = join_checked(whole, found.select(F.col("m").alias("message_id"), "parent", "top", F.col("depth").alias("d")), "message_id", "left")
        out = joined.withColumns({"parent_conv": F.col("parent.c"), "parent_turn": F.col("parent.t"), "thread_conv": F.coalesce("top.c", conv), "thread_turn": F.coalesce("top.t", turn), "reply_depth": F.coalesce("d", F.lit(0).cast("long")), "__linked": F.col("d").isNotNull()})
    own = F.when(F.col("__linked") | F.lit(not keep_unlinked), F.col("__own")).otherwise(F.coalesce(text, F.lit("")))
    return out.withColumn(text, own).select(*[f"`{c}`" for c in base.columns], *OUT)


def op1_quotation_links(spark, sf_dir):
    """All conversations without quotes, each message with its thread, parent and reply depth."""
    return link_quotes(read(spark, sf_dir, "conversations")).drop("message_id")


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, * FROM conversations),
ll AS (SELECT r, i, ls[i] AS line FROM (SELECT r, string_split(coalesce(text, ''), chr(10)) AS ls FROM m), unnest(range(1, len(ls) + 1)) u(i)),
mk AS (SELECT *, regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 0) AS mark FROM ll),
lv AS (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS content FROM mk),
nx AS (SELECT *, lag(level) OVER w AS before, lead(level) OVER w AS after FROM lv WINDOW w AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM nx),
passages AS (SELECT r, level, run, string_agg(content, chr(10) ORDER BY i) AS passage FROM runs WHERE level > 0 GROUP BY r, level, run),
owned AS (SELECT r, trim(string_agg(line, chr(10) ORDER BY i), chr(10)) AS own FROM runs
 WHERE level = 0 AND NOT (coalesce(after, 0) > 0 AND regexp_matches(line, '(?i)^\s*(on\b.*|\S.*)\bwrote:\s*$')) GROUP BY r),
msg AS (SELECT m.r, conv_id, turn, role, coalesce(m.text, '') AS whole, coalesce(p.n, 0) AS n_quotes, CASE WHEN p.n IS NULL THEN coalesce(m.text, '') ELSE coalesce(own, '') END AS own
 FROM m LEFT JOIN (SELECT r, count(*) AS n FROM passages GROUP BY r) p ON p.r = m.r LEFT JOIN owned o ON o.r = m.r),
parts AS (SELECT conv_id, turn, unnest([own] || regexp_split_to_array(own, '\n[ \t]*\n') || string_split(own, chr(10))) AS part FROM msg WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
units AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS key FROM parts),
asked AS (SELECT r, level, 0 AS part, passage AS t FROM passages UNION ALL SELECT r, level, 1, unnest(string_split(passage, chr(10))) FROM passages),
quotes AS (SELECT msg.r, conv_id, turn, level, part, trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS key
 FROM asked JOIN msg ON msg.r = asked.r WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
near AS (SELECT conv_id, key, min(turn) AS t FROM units WHERE key <> '' GROUP BY conv_id, key),
common AS (SELECT key, conv_id AS c, t FROM near WHERE len(string_split(key, ' ')) >= 3),
found AS (SELECT r, {'far': 0, 'level': level, 'part': part, 'c': q.conv_id, 't': near.t} AS f FROM quotes q JOIN near ON near.conv_id = q.conv_id AND near.key = q.key WHERE near.t < q.turn
 UNION ALL SELECT r, {'far': CASE WHEN o.c < conv_id THEN 1 ELSE 2 END, 'level': level, 'part': part, 'c': o.c, 't': o.t}
 FROM (SELECT q.r, q.conv_id, q.level, q.part, min({'c': far.c, 't': far.t}) AS o FROM quotes q JOIN common far ON far.key = q.key AND far.c <> q.conv_id GROUP BY q.r, q.conv_id, q.level, q.part, q.key)),
best AS (SELECT r, min(f) AS f FROM found GROUP BY r),
step AS (SELECT b.r, p.r AS x FROM best b JOIN msg p ON p.conv_id = b.f.c AND p.turn = b.f.t),
reach AS (SELECT r, x FROM step UNION SELECT a.r, b.x FROM reach a JOIN step b ON b.r = a.x),
ring AS (SELECT a.r, min({'c': conv_id, 't': turn}) AS low FROM reach a JOIN reach b ON a.r = b.r JOIN msg p ON p.r = b.x WHERE a.r = a.x GROUP BY a.r),
every AS (SELECT b.r, b.f FROM best b JOIN msg p ON p.r = b.r LEFT JOIN ring ON ring.r = b.r WHERE ring.r IS NULL OR NOT (low.c = conv_id AND low.t = turn)),
stroll AS (SELECT r, 1 AS depth, f.c AS tc, f.t AS tt FROM every
 UNION ALL SELECT w.r, w.depth + 1, b.f.c, b.f.t FROM stroll w JOIN msg p ON p.conv_id = w.tc AND p.turn = w.tt JOIN every b ON b.r = p.r),
heads AS (SELECT r, max(depth) AS depth, arg_max(tc, depth) AS tc, arg_max(tt, depth) AS tt FROM stroll GROUP BY r)
SELECT conv_id, turn, role, CASE WHEN every.r IS NULL THEN whole ELSE own END AS text, coalesce(tc, conv_id) AS thread_conv, coalesce(tt, turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS reply_depth,
 every.f.c AS parent_conv, every.f.t AS parent_turn, n_quotes::BIGINT AS n_quotes
FROM msg LEFT JOIN heads ON heads.r = msg.r LEFT JOIN every ON every.r = msg.r
"""
