"""Substring dedup with suffix automata of reference shards.

A window of `WIDTH` words is a repeat if its words also start in a document with a smaller id. Suffix automata of words
are built from reference text, each state knowing the first document that has its words; streaming a text through an
automaton gives its matching statistics, and every place where `WIDTH` words or more match an earlier document is a
window to remove. The automata alone decide: nothing else compares windows, and they compare words, not hashes.

The reference is the corpus itself, so what can't match is kept out of it. A window's anchor is the least hash among
its runs of `GRAM` words, so equal windows have equal anchors. Windows whose anchor only one document has are left out;
the others form passages, runs of windows with one anchor. Passages that occur often enter the reference once, with the
first document that has them, and are dealt into shards by anchor.

A reference of up to `BROADCAST_PASSAGES` passages (counted first) is broadcast: its shards' automata go to every task,
and whole documents are streamed through them. A larger one isn't, as sending all shards to all documents grows with
the square of the corpus: there, a shard's automaton meets the passages of its own anchors only, which are all that
can match it, and the first documents it finds are joined to the passages' places. Both ways give the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import discard, small_parts, stored, tidy
from sentrylake.llm.words import Words, batch_words, gram_hashes, slices

WIDTH, GRAM = 13, 6
SHARD_PASSAGES = 6000  # of a reference shard, about
BROADCAST_PASSAGES = 24_000
RUN = 64  # windows of a passage at most
ANCHOR_PASSAGES = 2000  # different passages of one anchor from which its windows are dealt one by one


def window_anchors(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The word that each window of one text begins with, ascending, and the window's anchor."""
    g = gram_hashes(words.hashes, gram)
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = g[:n].copy()
    for j in range(1, width - gram + 1):
        np.minimum(least, g[j : j + n], out=least)
    begins = np.flatnonzero(np.arange(n) + width <= np.repeat(words.first[1:], np.diff(words.first))[:n])
    return begins, least[begins]


class SuffixAutomaton:
    """Of sequences of words; each state knows the first (smallest) document that has its words."""

    def __init__(self, **built):
        self.next: list[dict] = [{}]
        self.link, self.length, self.doc = [-1], [0], [0]
        vars(self).update(built)

    def add(self, words: list, doc: int) -> None:
        """Sequences come in ascending order of documents. No match runs over a sequence's end."""
        nxt, link, length, docs = self.next, self.link, self.length, self.doc
        last = 0
        for w in words:
            p = last
            q = nxt[p].get(w)
            if q is not None and length[q] == length[p] + 1:
                last = q
                continue
            if q is not None:  # the words so far end in q, but q has longer ones too
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                docs.append(docs[q])
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = clone
                last = clone
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            docs.append(doc)
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    docs.append(docs[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def first_documents(self, words: list, width: int) -> Iterator[tuple[int, int]]:
        """(start, smallest document) of the windows of `words` that the automaton has: where a match reaches `width`."""
        nxt, link, length, docs = self.next, self.link, self.length, self.doc
        state = matched = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= width:
                u = state
                while length[link[u]] >= width:
                    u = link[u]
                yield i - width + 1, docs[u]

    def spans(self, words: list, doc: int, width: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of at least `width` words with smaller documents."""
        out: list[tuple[int, int]] = []
        for start, first in self.first_documents(words, width):
            if first < doc:
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], start + width)
                else:
                    out.append((start, start + width))
        return out


def shard_automaton(frame: pd.DataFrame) -> SuffixAutomaton:
    """Of the passages of a shard, the first documents first."""
    automaton = SuffixAutomaton()
    frame = frame.sort_values("first", kind="stable")
    for doc, text in zip(frame["first"].tolist(), frame["words"]):
        automaton.add(text.split(" "), doc)
    return automaton


def shard_matches(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """Of each passage of a shard, the windows that the shard's automaton has and the first document of each."""
    automaton = shard_automaton(frame)
    found = [list(automaton.first_documents(text.split(" "), width)) for text in frame["words"]]
    return pd.DataFrame({"anchor": frame["anchor"], "key": frame["key"], "at": [[a for a, _ in f] for f in found], "owners": [[d for _, d in f] for f in found]})


def shared_anchors(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, anchors) of the anchors that another document has too. keyed: (id long, th long, text)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_parts(whole, "text")):
            words = batch_words(batch.column("text"))
            begins, found = window_anchors(words, width, gram)
            cuts = np.searchsorted(begins, words.first)
            lists = [np.unique(found[a:b]).astype(np.int64) for a, b in zip(cuts, cuts[1:])]
            ends = pa.array(np.cumsum([0] + [len(x) for x in lists], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists or [np.zeros(0, dtype=np.int64)])))], names=["id", "anchors"])

    # written once, as each text's anchors are read twice
    kept = stored(keyed.select("id", "text").mapInArrow(tidy(anchors), "id long, anchors array<long>").where("size(anchors) > 0"), "all-anchors")
    anchored = kept.select("id", F.explode("anchors").alias("anchor"))
    shared = anchored.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    by_doc = stored(anchored.join(shared.hint("merge"), "anchor").groupBy("id").agg(F.collect_list("anchor").alias("anchors")), "anchors")
    discard(kept)
    return by_doc


def passages(keyed: DataFrame, by_doc: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, th, start, anchor, words): the runs of windows that have one anchor, a shared one; words are parted by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_parts(whole, "text")):
            words = batch_words(batch.column("text"))
            begins, found = window_anchors(words, width, gram)
            # an anchor that is shared is so in every text
            known = np.unique(batch.column("anchors").flatten().to_numpy().astype(np.uint64))
            here = known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found if len(known) else np.zeros(len(found), dtype=bool)
            begins, found = begins[here], found[here]
            head = np.ones(len(begins), dtype=bool)
            head[1:] = (found[1:] != found[:-1]) | (begins[1:] != begins[:-1] + 1)
            of_head = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            head |= (np.arange(len(head)) - of_head) % RUN == 0
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(begins))[: len(at)] - 1
            row = np.searchsorted(words.first, begins[at], side="right") - 1
            texts = slices(words.single_blanks(), words.starts[begins[at]], words.ends[begins[last] + width - 1]).cast(pa.string())
            columns = [batch.column("id").take(pa.array(row)), batch.column("th").take(pa.array(row)), pa.array(begins[at] - words.first[row]), pa.array(found[at].astype(np.int64)), texts]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "start", "anchor", "words"])

    joined = keyed.join(by_doc.hint("merge"), "id")
    cut_up = joined.mapInArrow(tidy(cut), "id long, th long, start long, anchor long, words string")
    # blanks that are doubled in a text aren't in a passage
    one = F.when(F.col("words").contains("  "), F.regexp_replace("words", " +", " ")).otherwise(F.col("words"))
    return stored(cut_up.withColumn("words", one).withColumn("key", F.xxhash64("words")), "passages")


def windows_apart(found: DataFrame, width: int) -> DataFrame:
    """The windows of passages as passages of their own, their anchor made from all of their words."""
    words = F.split("words", " ")
    each = found.select("id", "th", "start", words.alias("w"), F.explode(F.sequence(F.lit(0), F.size(words) - width)).alias("j"))
    each = each.select("id", "th", (F.col("start") + F.col("j")).alias("start"), F.array_join(F.slice("w", F.col("j") + 1, width), " ").alias("words"))
    return each.select("id", "th", "start", F.xxhash64("words", F.lit(13)).alias("anchor"), "words", F.xxhash64("words").alias("key"))


def reference_of(found: DataFrame) -> DataFrame:
    """Each passage once, with the first document that has it."""
    return found.groupBy("anchor", "words").agg(F.min("id").alias("first"), F.first("key").alias("key"))


def balanced(found: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Passages and their reference, no anchor with more than about `ANCHOR_PASSAGES` of the reference."""
    reference = stored(reference_of(found), "reference")
    busy = stored(reference.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ANCHOR_PASSAGES).select("anchor"), "busy-anchors")
    if busy.isEmpty():
        return found, reference
    apart = stored(windows_apart(found.join(busy, "anchor", "left_semi"), width), "windows")
    rest = lambda df: df.join(busy, "anchor", "left_anti")
    return rest(found).unionByName(apart), rest(reference).unionByName(reference_of(apart))


def in_shards(reference: DataFrame, n: int) -> DataFrame:
    return reference.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-n // SHARD_PASSAGES)))))


def repeated_windows(found: DataFrame, reference: DataFrame, n: int, width: int) -> DataFrame:
    """(id, th, gone array<long>): the starts of the windows that an earlier document has."""
    owners = in_shards(reference, n).groupBy("shard").applyInPandas(lambda f: shard_matches(f, width), "anchor long, key long, at array<int>, owners array<long>")
    placed = found.select("id", "th", "start", "anchor", "key").join(owners.hint("merge"), ["anchor", "key"])
    windows = F.filter(F.arrays_zip("at", "owners"), lambda x: x["owners"] < F.col("id"))
    hits = placed.select("id", "th", F.transform(windows, lambda x: F.col("start") + x["at"]).alias("gone")).where("size(gone) > 0")
    return hits.groupBy("id", "th").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def without_windows(batch: pa.RecordBatch, text: pa.Array, words: Words, starts: np.ndarray, width: int) -> list[pa.Array]:
    """Text, n_words, n_removed and kept of each row, without the windows that start at the words `starts` of the batch."""
    change = np.zeros(len(words.starts) + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    keep = np.cumsum(change[:-1]) == 0
    before = np.concatenate(([0], np.cumsum(~keep)))
    removed = before[words.first[1:]] - before[words.first[:-1]]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    at = np.searchsorted(edges[1::2], words.first, side="right")  # the first run that reaches into a text
    whole, plain = words.data.tobytes(), words.single_blanks().tobytes()
    texts, kept = [], []
    for k in range(batch.num_rows):
        low, high = int(words.first[k]), int(words.first[k + 1])
        own = [(max(a, low), min(b, high)) for a, b in runs[at[k] : at[k + 1] + 1] if a < high and b > low]
        spans = [plain[words.starts[a] : words.ends[b - 1]] for a, b in own]
        kept.append(b" ".join(s if b"  " not in s else b" ".join(s.split()) for s in spans))
        if removed[k]:
            end = words.offsets[k + 1]
            texts.append(b"".join(whole[words.starts[a] : words.starts[b] if b < high else end] for a, b in own))
        else:
            texts.append(None)
    cut = pa.array(texts, type=pa.binary()).cast(pa.string())
    return [cut.fill_null(text) if text.null_count == 0 else pa.array([t if t is not None else o for t, o in zip(cut.to_pylist(), text.to_pylist())], type=pa.string()), pa.array(np.diff(words.first)), pa.array(removed), pa.array(kept, type=pa.binary()).cast(pa.string())]


def dedup_substrings(df: DataFrame, id_column: str = "doc_id", column: str = "text", width: int = WIDTH, gram: int = GRAM, broadcast_passages: int = BROADCAST_PASSAGES) -> DataFrame:
    """`df` with `column` without repeated spans, plus n_words, n_removed and kept (the kept words, joined by a blank).

    A text that loses nothing stays as it is, blanks included. Null text has no words and stays null (kept is empty).
    Ids are integers; others must cast to long. Rows with a null id are neither reference nor changed. Rows that share
    an id are one document: they aren't compared with each other. Other columns are kept, whatever their names; those
    named like the three added give way.
    """
    added = ["n_words", "n_removed", "kept"]
    names = [c for c in df.columns if c not in added]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # columns go by number inside, so that no name clashes
    rows = df.select(quoted(id_column).cast("long").alias("id"), F.xxhash64(quoted(column)).alias("th"), *[quoted(c).alias(f"c{k}") for k, c in enumerate(names)])
    text = f"c{names.index(column)}"
    keyed = rows.where(F.col("id").isNotNull() & F.col(text).isNotNull()).select("id", "th", F.col(text).alias("text"))
    by_doc = shared_anchors(keyed, width, gram)
    found, reference = balanced(passages(keyed, by_doc, width, gram), width)
    discard(by_doc)
    n = reference.count()
    schema = df.select(*map(quoted, names)).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def output(batch: pa.RecordBatch, words: Words, starts: np.ndarray) -> pa.RecordBatch:
        whole, *rest = without_windows(batch, batch.column(text), words, starts, width)
        return pa.RecordBatch.from_arrays([whole if f"c{k}" == text else batch.column(f"c{k}") for k in range(len(names))] + rest, names=[*names, *added])

    if n <= broadcast_passages:
        build = lambda f: pd.DataFrame({"automaton": [pickle.dumps(vars(shard_automaton(f)))]})
        automata = [bytes(r.automaton) for r in in_shards(reference, n).groupBy("shard").applyInPandas(build, "automaton binary").collect()]
        sent = df.sparkSession.sparkContext.broadcast(automata)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [SuffixAutomaton(**pickle.loads(a)) for a in sent.value]
            for batch in (part for whole in batches for part in small_parts(whole, text)):
                words = batch_words(batch.column(text))
                starts: set[int] = set()
                for k, (doc, own) in enumerate(zip(batch.column("id").to_pylist(), batch.column(text).to_pylist())):
                    if doc is not None and own:
                        own, low = own.encode().split(), int(words.first[k])
                        own = [w.decode() for w in own]
                        for a, b in (span for h in held for span in h.spans(own, doc, width)):
                            starts.update(range(low + a, low + b - width + 1))
                yield output(batch, words, np.fromiter(starts, dtype=np.int64, count=len(starts)))

        return rows.mapInArrow(tidy(stream), schema)

    gone = stored(repeated_windows(found, reference, n, width), "gone").select(F.col("id").alias("g_id"), F.col("th").alias("g_th"), "gone")
    joined = rows.join(gone.hint("merge"), (F.col("id") == F.col("g_id")) & (F.col("th") == F.col("g_th")), "left").drop("g_id", "g_th")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_parts(whole, text)):
            words = batch_words(batch.column(text))
            lists = batch.column("gone").fill_null([])
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.unique(at + np.repeat(words.first[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))) if len(at) else at
            yield output(batch, words, starts)

    return joined.mapInArrow(tidy(cut), schema)


#: The same digests in DuckDB; windows are compared as text.
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {WIDTH - 2})) AS p, w FROM d WHERE len(w) >= {WIDTH}),
h AS (SELECT doc_id, p, array_to_string(w[p:p + {WIDTH - 1}], ' ') AS g FROM win),
o AS (SELECT g, min(doc_id) AS owner FROM h GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM h JOIN o USING (g) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM hit, range({WIDTH}) r(k)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
