"""The trie of conversation prefixes, its subtree totals by time-forward processing.

A node is a sequence of turns that some conversation starts with. Its name is a sum of hashes of (depth, turn) in four
lanes of 32 bits, so that names of all prefixes are running sums and a parent's name is a subtraction; running sums are
cut into stretches of `STRETCH` turns, so that no conversation is summed in one task. Texts are hashed where they are
read and never shuffled.

Totals go from children to parents as messages. Nodes stand in reverse level order (Spark's external sort); a node takes
the messages addressed to it from a priority queue, which spills sorted runs, adds its own, and sends the total on to its
parent's place in the order. Shards are subtrees: a node with at most about the square root of all conversations below
it belongs to the subtree of its topmost such ancestor, cut again at every `STRETCH` levels. What the shards pass on
is processed the same way across shard roots, together with the few nodes above them; shards that others hang from then
get these totals as messages among their nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import stored

STRETCH = 1024  # turns summed, and levels of a shard, at a time
ROOM = 200_000  # messages held in memory; more are spilled
CHUNK = 1 << 16  # ids joined to one text before hashing
LANES = range(4)
ROOT = bytes(32)


def conversation_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, k, digest, bytes): each conversation's turns numbered from 1 in order of `turn`, null first.

    Equal numbers go by the SHA-256 of length of role, role and text; a null role or text is empty; repeated rows are turns of
    their own; rows without a conversation are left out.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    role_, text_ = F.coalesce(quoted(role), F.lit("")), F.coalesce(quoted(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws("|", F.length(role_), role_, text_), 256))
    rows = df.where(quoted(conv).isNotNull()).select(quoted(conv).alias("conv_id"), quoted(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
    rows = rows.withColumn("_salt", F.monotonically_increasing_id())
    # ranges also cut a conversation, or equal rows, that one task could not hold
    ranged = stored(rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest", "_salt").withColumn("_part", F.spark_partition_id()), "turns")
    upto = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(F.asc_nulls_first("turn"), "digest", "_salt"))
    return ranged.withColumn("_own", own).join(before, ["conv_id", "_part"]).select("conv_id", (F.col("_own") + F.col("_before")).alias("k"), "digest", "bytes")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c as the first h turns of conversation c - c % every, then its own after its first h; h = crc32(c) % most.

    Gives (conv_id, depth, digest, bytes, last) and (conv_id, length). A conversation that isn't there gives no turns.
    """
    turns = stored(turns, "numbered")
    lengths = turns.groupBy("conv_id").agg(F.max("k").alias("_len"))
    heads = turns.where(F.col("k") < most)
    starts = lengths.select("conv_id", "_len", (F.col("conv_id") - F.col("conv_id") % every).alias("_base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("_h"))
    held = starts.join(lengths.select(F.col("conv_id").alias("_base"), F.least("_len", F.lit(most)).alias("_has")), "_base", "left")
    taken = F.least("_h", F.coalesce("_has", F.lit(0)))
    plan = held.withColumn("_m", taken).withColumn("length", F.col("_m") + F.greatest(F.col("_len") - F.col("_h"), F.lit(0)))
    plan = stored(plan.select("conv_id", "_base", "_h", "_m", "length"), "plan")
    head = plan.where("_m > 0").join(heads.withColumnRenamed("conv_id", "_base"), "_base").where("k <= _m")
    tail = turns.join(plan, "conv_id").where("k > _h").withColumn("k", F.col("_m") + F.col("k") - F.col("_h"))
    cols = ["conv_id", F.col("k").cast("long").alias("depth"), "digest", "bytes", (F.col("k") == F.col("length")).alias("last")]
    return head.select(*cols).unionByName(tail.select(*cols)), plan.select("conv_id", "length")


class MessageQueue:
    """Messages by priority, least first. Beyond `room` they are spilled as sorted runs to unnamed scratch files of the task,
    which are gone with it and which nothing else reads."""

    def __init__(self, room: int = ROOM):
        self.room, self.heap, self.runs = room, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.room:
            self.heap.sort()
            kept = self.room // 2
            spilled, self.heap = self.heap[kept:], self.heap[:kept]
            self._run(spilled)

    def _run(self, messages: list[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for at in range(0, len(messages), 1000):
            pickle.dump(messages[at : at + 1000], file)
        file.seek(0)
        self._next(file)

    def _next(self, file) -> None:
        """The next piece of a run; runs are a heap by their first message."""
        try:
            piece = pickle.load(file)
        except EOFError:
            file.close()
            return
        heapq.heappush(self.runs, (piece[0], id(file), piece[::-1], file))

    def pop_until(self, priority: tuple) -> Iterator[tuple]:
        """Messages of this priority and before, in order."""
        while True:
            least, first = (self.heap[0] if self.heap else None), (self.runs[0][0] if self.runs else None)
            if first is not None and (least is None or first < least):
                if first[: len(priority)] > priority:
                    return
                _, name, piece, file = heapq.heappop(self.runs)
                yield piece.pop()
                if piece:
                    heapq.heappush(self.runs, (piece[-1], name, piece, file))
                else:
                    self._next(file)
            elif least is not None and least[: len(priority)] <= priority:
                yield heapq.heappop(self.heap)
            else:
                return


def time_forward(room: int):
    """mapInArrow over rows (shard, level, id, node, parent_level, parent, children, leaves, saved, sends) in order of shard, level
    from high to low, id and node: adds up the three numbers of all that is below each row of `node` true, and leaves out the others,
    which are messages. A row sends its totals on, with `sends` as its children, unless `parent` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = MessageQueue(room)
        for batch in batches:
            d = {n: batch.column(n).to_pylist() for n in ("shard", "level", "id", "node", "parent_level", "parent", "children", "leaves", "saved", "sends")}
            keep, sums = [], ([], [], [])
            for k in range(batch.num_rows):
                place = (d["shard"][k], -d["level"][k], d["id"][k])
                own = [d["children"][k], d["leaves"][k], d["saved"][k]]
                if not d["node"][k]:
                    queue.push((*place, *own))
                    continue
                for message in queue.pop_until(place):
                    own = [a + b for a, b in zip(own, message[3:])]
                if d["parent"][k] is not None:
                    queue.push((d["shard"][k], -d["parent_level"][k], d["parent"][k], d["sends"][k], own[1], own[2]))
                keep.append(k)
                for s, v in zip(sums, own):
                    s.append(v)
            out = batch.take(pa.array(keep, pa.int64()))
            for name, s in zip(("children", "leaves", "saved"), sums):
                out = out.set_column(out.schema.get_field_index(name), name, pa.array(s, pa.int64()))
            yield out

    return run


FORWARD = "shard binary, level long, id binary, node boolean, parent_level long, parent binary, children long, leaves long, saved long, sends long"


def forward(df: DataFrame, extra: list[str], room: int) -> DataFrame:
    """`time_forward` over rows dealt by shard; `extra` columns stay."""
    names = [c.split()[0] for c in FORWARD.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dealt = df.select(*names, *extra).repartition("shard").sortWithinPartitions("shard", F.desc("level"), "id", "node")
    return dealt.mapInArrow(time_forward(room), ", ".join([FORWARD, *[f"{c} {kinds[c]}" for c in extra]]))


def _name(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in lanes]))


def path_rows(turns: DataFrame, stretch: int) -> DataFrame:
    """Turns (conv_id, depth, digest, bytes, last) with the names of their node, its parent and the node that ends the stretch before."""
    hashed = F.sha2(F.concat_ws(":", "depth", F.hex("digest")), 256)
    lane = lambda i: F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long")
    rows = turns.withColumn("_hash", hashed).withColumns({f"h{i}": lane(i) for i in LANES} | {"_stretch": F.floor((F.col("depth") - 1) / stretch)}).drop("_hash", "digest")
    within = Window.partitionBy("conv_id", "_stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "_stretch").agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in LANES])
    above = sums.select("conv_id", "_stretch", *[F.sum(f"s{i}").over(upto).alias(f"q{i}") for i in LANES]).where("_stretch > 0")
    both = rows.withColumns({f"p{i}": F.sum(f"h{i}").over(within) for i in LANES}).join(above, ["conv_id", "_stretch"], "left")
    q = [F.coalesce(f"q{i}", F.lit(0)) for i in LANES]
    whole = [F.col(f"p{i}") + q[i] for i in LANES]
    return both.select(
        "conv_id", "depth", "bytes", "last", _name(whole).alias("id"), _name([w - F.col(f"h{i}") for i, w in enumerate(whole)]).alias("parent"), _name(q).alias("cut"), "_stretch"
    )


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv_id): the SHA-256 of the ids in order, joined by commas.

    Ranges of (id, conv_id) are joined to texts of up to `CHUNK` ids in many tasks; a node's texts are then hashed as they stream by.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held = None, None, []
        for batch in batches:
            ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done: list[tuple] = []
            for own, conv in zip(ids, convs):
                if own != node or len(held) == CHUNK:
                    if held:
                        done.append((node, first, ",".join(held)))
                    node, first, held = own, conv, []
                held.append(str(conv))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["id", "first", "text"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["id", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["id", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])

    ranged = ends.select("id", F.col("conv_id").cast("long")).repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    texts = stored(ranged.mapInArrow(joined, "id binary, first long, text string"), "ends")
    return texts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id binary, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, stretch: int = STRETCH, limit: int | None = None, room: int = ROOM) -> DataFrame:
    """One row per node from turns (conv_id, depth from 1, digest, bytes, last) and conversations (conv_id, length), turnless ones too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; no conversations, no rows.
    `limit`: conversations of a shard, the square root of all if not given. The result is the same for any of the three.
    """
    rows = stored(path_rows(turns, stretch), "paths")
    ends = F.count_if("last").alias("n_ends")
    nodes = rows.groupBy("depth", "id").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), ends, F.max("bytes").alias("bytes"), F.min("parent").alias("parent"), F.min("cut").alias("cut"), F.min("_stretch").alias("_stretch"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).where("n_convs > 0")
    none = F.lit(None).cast("binary")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("id"), "conv_id", "n_convs", "n_ends", F.lit(0).cast("long").alias("bytes"), none.alias("parent"), none.alias("cut"), F.lit(0).cast("long").alias("_stretch"))
    if limit is None:
        limit = max(64, isqrt(conversations.count()))
    top = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    own = {"leaves": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"), "top": top}
    nodes = stored(nodes.unionByName(root).withColumns(own), "nodes")
    tops = nodes.where("top")

    # the topmost node of each conversation's path that isn't among the tops roots the shard
    below = rows.join(tops.select("id"), "id", "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "id")).alias("_light"))
    held = nodes.where("not top").join(below, "conv_id")
    deep = F.col("_light.depth") <= F.col("_stretch") * stretch
    marked = lambda mark, c: F.concat(F.lit(bytes([mark])), c)
    shard = F.when(deep, marked(1, F.col("cut"))).otherwise(marked(0, F.col("_light.id")))
    is_root = F.when(deep, F.col("depth") == F.col("_stretch") * stretch + 1).otherwise(F.col("id") == F.col("_light.id"))
    light = stored(held.withColumns({"shard": shard, "deep": deep, "is_root": is_root}).drop("_light", "top", "cut"), "light")

    # across shard roots: tops, and the shards that hang from other shards or have such hanging from them
    sums = light.groupBy("shard", "deep").agg(F.count_if("is_root").alias("sends"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min(F.when(F.col("is_root"), F.col("parent"))).alias("attach"), (F.min("depth") - 1).alias("at"))
    hanging = sums.where("deep").join(light.select(F.col("id").alias("attach"), F.col("shard").alias("up")), "attach")
    ups = hanging.select(F.col("up").alias("shard")).distinct().withColumn("_in", F.lit(True))
    known = stored(sums.join(hanging.select("shard", "up"), "shard", "left").join(ups, "shard", "left"), "shards")
    alone = F.col("up").isNull() & F.col("_in").isNull()
    plain = known.where(alone).groupBy(F.col("attach").alias("id")).agg(F.sum("sends").alias("children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    zero = F.lit(0).cast("long")
    up_tops = tops.join(plain, "id", "left").select(
        F.lit(b"").alias("shard"), (F.col("depth") * 2).alias("level"), marked(2, F.col("id")).alias("id"), F.lit(True).alias("node"), ((F.col("depth") - 1) * 2).alias("parent_level"), marked(2, F.col("parent")).alias("parent"),
        F.coalesce("children", zero).alias("children"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), F.lit(1).cast("long").alias("sends"),
        none.alias("attach"), none.alias("up"), zero.alias("at"),
    )
    up_at = known.select("shard", F.col("at").alias("up_at")).withColumnRenamed("shard", "up")
    up_shards = known.where(~alone).join(up_at, "up", "left").select(
        F.lit(b"").alias("shard"), (F.col("at") * 2 + 1).alias("level"), F.col("shard").alias("id"), F.lit(True).alias("node"), F.when(F.col("up").isNull(), F.col("at") * 2).otherwise(F.col("up_at") * 2 + 1).alias("parent_level"),
        F.coalesce("up", marked(2, F.col("attach"))).alias("parent"), zero.alias("children"), "leaves", "saved", "sends", "attach", "up", "at",
    )
    above = stored(forward(up_tops.unionByName(up_shards), ["attach", "up", "at"], room), "above")

    sent = above.where("up is not null").select(
        F.col("up").alias("shard"), F.col("at").alias("level"), F.col("attach").alias("id"), F.lit(False).alias("node"), zero.alias("parent_level"), none.alias("parent"), F.col("sends").alias("children"), "leaves", "saved", zero.alias("sends"),
        zero.alias("conv_id"), zero.alias("n_convs"), none.alias("up_id"),
    )
    inside = light.select(
        "shard", F.col("depth").alias("level"), "id", F.lit(True).alias("node"), (F.col("depth") - 1).alias("parent_level"), F.when(~F.col("is_root"), F.col("parent")).alias("parent"), zero.alias("children"), "leaves", "saved", F.lit(1).cast("long").alias("sends"),
        F.col("conv_id").cast("long").alias("conv_id"), "n_convs", F.col("parent").alias("up_id"),
    )
    low = forward(inside.unionByName(sent), ["conv_id", "n_convs", "up_id"], room).select("id", F.col("level").alias("depth"), "conv_id", "n_convs", "up_id", "children", "leaves", "saved")
    summed = above.where(F.substring("id", 1, 1) == F.lit(b"\2")).select(F.expr("substring(id, 2)").alias("id"), "children", "leaves", "saved")
    high = tops.drop("leaves", "saved").join(summed, "id").select("id", "depth", F.col("conv_id").cast("long").alias("conv_id"), "n_convs", F.col("parent").alias("up_id"), "children", "leaves", "saved")
    ended = rows.where("last").select("id", "conv_id").unionByName(conversations.where("length = 0").select(F.lit(ROOT).alias("id"), "conv_id"))
    parents = nodes.select(F.col("id").alias("up_id"), F.col("conv_id").cast("long").alias("parent_conv_id"))
    return low.unionByName(high).join(parents, "up_id", "left").join(ends_hashes(ended), "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; see `conversation_turns` for order, nulls and repeated rows, `trie` for the columns.

    An empty table gives no nodes; texts of any length count by their UTF-8 bytes; other columns aren't read.
    """
    turns = stored(conversation_turns(df, conv, turn, role, text), "numbered")
    lengths = turns.groupBy("conv_id").agg(F.max("k").alias("length"))
    rows = turns.join(lengths, "conv_id").select("conv_id", F.col("k").cast("long").alias("depth"), "digest", "bytes", (F.col("k") == F.col("length")).alias("last"))
    return trie(rows, lengths)


#: c has the CRC-32 of a conversation's decimal id, a bit a step; r the rebuilt conversations.
ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(length(coalesce(role, '')) || '|' || coalesce(role, '') || '|' || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns FROM t GROUP BY 1),
c AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR d IN string_split(conv_id::VARCHAR, '')])),
    lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 9 AS h FROM l),
r AS (SELECT c.conv_id, coalesce(b.turns[:h], []) || c.turns[h + 1:] AS turns FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d, turns[:d] AS path, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(ends) AS leaf, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends,
    CASE WHEN d > 0 THEN (count(*) - 1) * strlen(path[d].text) ELSE 0 END AS saved FROM p GROUP BY path, d),
a AS (SELECT n.*, path[:up] AS above, d - up AS far FROM (SELECT *, unnest(range(d + 1)) AS up FROM n) n),
s AS (SELECT above, count(*) FILTER (WHERE far = 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.above = n.path LEFT JOIN n u ON n.d > 0 AND u.path = n.path[:n.d - 1]
"""
