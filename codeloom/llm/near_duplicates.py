"""Near-duplicate records by T-occurrence search.

A record asks for partners that are no larger than itself; such a partner shares at least
T = ceil(t * size) of its tokens. As in DivideSkip, the inverted lists of the record are
divided into short ones (its rarest tokens) and the L = T - m longest: a partner must be
on at least m of the short lists. The short lists of a record come together in a task and
are merged by a heap; the partners that are on enough of them are then probed in the long
lists by binary search. Long lists are never moved: whether a partner is on the list of a
token is looked up in the partner's own sorted tokens, the same relation read from the
other side, so that only a record's long tokens travel, once per candidate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.components import connected_components
from codeloom.llm.words import K, letters, mix, word_hashes
from codeloom.session import materialize, spread

PARTNER_BLOCK = 200_000  # partners that a task merges or holds of one list at a time
LONG_LIST = 4096  # a list longer than this counts as long; its exact length no longer matters
_WORD = letters(b"_")


def shingle_sets(texts: pa.Array, n: int, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of word runs for a column of texts, without a Python string.

    Returns (row, shingle) pairs sorted by both, and for the rows that have at least
    ``min_tokens`` tokens (and one n-gram) their set key and set size; other rows have size 0.
    """
    count = len(texts)
    keys, sizes = np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=np.int64)
    row, hashed = word_hashes(texts, _WORD)
    nothing = row[:0], hashed[:0], keys, sizes
    enough = np.bincount(row, minlength=count) >= min_tokens
    if len(hashed) < n:
        return nothing
    last = len(hashed) - n + 1
    gram = np.zeros(last, dtype=np.uint64)
    for i in range(n):
        gram = gram * K + hashed[i : i + last]
    gram, home = mix(gram), row[:last]
    ok = (row[n - 1 :] == home) & enough[home]
    gram, home = gram[ok], home[ok]
    order = np.lexsort((gram, home))
    gram, home = gram[order], home[order]
    if not len(gram):
        return nothing
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (home[1:] != home[:-1])
    gram, home = gram[new], home[new]
    begin = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
    total = np.diff(np.r_[begin, len(home)])
    keys[home[begin]] = mix(np.add.reduceat(mix(gram + K), begin) + total.astype(np.uint64))
    sizes[home[begin]] = total
    return home, gram, keys, sizes


def _members(batches: Iterator[pa.RecordBatch], n: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, _, keys, sizes = shingle_sets(b.column("text"), n, min_tokens)
        some = sizes > 0
        yield pa.RecordBatch.from_arrays(
            [b.column("id").filter(pa.array(some)), pa.array(keys[some].view(np.int64)), pa.array(sizes[some].astype(np.int32)), b.column("at").filter(pa.array(some))],
            ["id", "key", "size", "at"],
        )


def _tokens(batches: Iterator[pa.RecordBatch], n: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, gram, keys, _ = shingle_sets(b.column("text"), n, min_tokens)
        _, firsts = np.unique(keys, return_index=True)  # copies within the batch are sent once
        sent = np.isin(row, firsts)
        yield pa.RecordBatch.from_arrays([pa.array(gram[sent].view(np.int64)), pa.array(keys[row[sent]].view(np.int64))], ["token", "key"])


def _lists(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Lengths of the inverted lists over rows sorted by (token, key), in bounded memory.

    Drops lists of one record: they join nothing. A list is held back only until it is
    known to be long, then streamed on with length ``longest``.
    """
    held_t, held_k = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    streaming: int | None = None  # the token whose long list is passing
    last: tuple[int, int] | None = None

    def out(t: np.ndarray, k: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(k), pa.array(df.astype(np.int32))], ["token", "key", "df"])

    def runs(t: np.ndarray) -> np.ndarray:
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        return np.repeat(np.diff(np.r_[begin, len(t)]), np.diff(np.r_[begin, len(t)]))

    for b in batches:
        t, k = b.column("token").to_numpy(), b.column("key").to_numpy()
        if not len(t):
            continue
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        new[0] = last != (int(t[0]), int(k[0]))
        last = (int(t[-1]), int(k[-1]))
        t, k = np.concatenate([held_t, t[new]]), np.concatenate([held_k, k[new]])
        if streaming is not None:
            same = t == streaming
            if same.any():
                yield out(t[same], k[same], np.full(int(same.sum()), longest))
                t, k = t[~same], k[~same]
            if len(t):
                streaming = None
        if not len(t):
            held_t, held_k = t, k
            continue
        cut = int(np.searchsorted(t, t[-1]))
        done_t, done_k, held_t, held_k = t[:cut], k[:cut], t[cut:], k[cut:]
        if len(done_t):
            df = runs(done_t)
            keep = df > 1
            yield out(done_t[keep], done_k[keep], np.minimum(df[keep], longest))
        if len(held_t) >= longest:
            yield out(held_t, held_k, np.full(len(held_t), longest))
            streaming, held_t, held_k = int(held_t[-1]), held_t[:0], held_k[:0]
    if len(held_t) > 1:
        yield out(held_t, held_k, np.full(len(held_t), len(held_t)))


def _offers(batches: Iterator[pa.RecordBatch], threshold: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Slices of inverted lists for the records that merge them, over rows sorted by (token, cell, size, key).

    A record gets the members before it that are not too small for it, per block of partners and in
    order, all lists of a batch at once. Held on to is only the stretch of the last list whose sizes still matter;
    in a cell of its own a split list shows one block of members to all records that ask.
    """
    held = None  # token, cell, sizes and keys of the list that goes on
    for b in batches:
        t, c, n, k = (b.column(x).to_numpy() for x in ("token", "cell", "size", "key"))
        query, member = (b.column(x).to_numpy(zero_copy_only=False) for x in ("query", "member"))
        if not len(t):
            continue
        if held and held[:2] == (t[0], c[0]):
            more = len(held[2])
            t, c = np.r_[np.full(more, t[0]), t], np.r_[np.full(more, c[0]), c]
            n, k = np.r_[held[2], n], np.r_[held[3], k]
            query, member = np.r_[np.zeros(more, dtype=bool), query], np.r_[np.ones(more, dtype=bool), member]
        cell = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (c[1:] != c[:-1])]).astype(np.int64) << 32
        place, keys, had = (cell | n)[member], k[member], np.cumsum(member) - member
        ask = np.flatnonzero(query)
        lo = np.searchsorted(place, cell[ask] | np.ceil(n[ask] * threshold - 1e-9).astype(np.int64))
        some = lo < had[ask]
        ask, lo, length = ask[some], lo[some], (had[ask] - lo)[some]
        part = np.cumsum(length) // 500_000
        for x in range(int(part[-1]) + 1 if len(part) else 0):
            on = part == x
            rows, first, size = ask[on], lo[on], length[on]
            if len(rows):
                owner = np.repeat(np.arange(len(rows)), size)
                value = keys[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
                block = _block(value, blocks)
                order = np.lexsort((value, block, owner))
                owner, value, block = owner[order], value[order], block[order]
                begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])
                of = rows[owner[begin]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(value)].astype(np.int32)), pa.array(value))
                yield pa.RecordBatch.from_arrays([pa.array(k[of]), pa.array(block[begin].astype(np.int32)), pa.array(t[of]), lists], ["key", "block", "token", "partners"])
        stay = member & (cell == cell[-1]) & (n >= n[-1] * threshold - 1e-9)
        held = (t[-1], c[-1], n[stay], k[stay])


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(33)).astype(np.int64) % blocks


def _merged(lists: list[np.ndarray], least: int) -> tuple[list[int], list[int]]:
    """Heap merge of sorted lists: the partners on at least ``least`` of them, and on how many."""
    found, counts, last, n = [], [], None, 0
    for k in heapq.merge(*(x.tolist() for x in lists)):
        if k == last:
            n += 1
            continue
        if n >= least:
            found.append(last)
            counts.append(n)
        last, n = k, 1
    if n >= least and last is not None:
        found.append(last)
        counts.append(n)
    return found, counts


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each record and block over rows sorted by (key, block, partners given): first the record itself, then its lists.

    A record's own row says how many short lists a partner must be on, its size and its long tokens.
    """
    at, own, lists = None, None, []

    def settle() -> pa.RecordBatch:
        found, counts = _merged(lists, own[0])
        n = len(found)
        long = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(own[2])), pa.array(np.tile(own[2], n), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, at[0]), pa.int64()), pa.array(np.full(n, own[1]), pa.int32()), pa.array(found, pa.int64()), pa.array(counts, pa.int32()), long], ["key_a", "size_a", "key_b", "n", "long"])

    for b in batches:
        k, block, hits, size = (b.column(x).to_numpy() for x in ("key", "block", "hits", "size"))
        partners, long = b.column("partners"), b.column("long")
        for i in range(len(k)):
            if (k[i], block[i]) != at:
                if len(lists) > 0 and own is not None and len(lists) >= own[0]:
                    yield settle()
                at, own, lists = (k[i], block[i]), None, []
            if hits[i] > 0:
                own = (int(hits[i]), int(size[i]), np.asarray(long[i].values, dtype=np.int64))
            else:
                lists.append(np.asarray(partners[i].values))
    if lists and own is not None and len(lists) >= own[0]:
        yield settle()


def _probe(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Adds to the count of a candidate the long lists it is on, each looked up by binary search; keeps the similar ones.

    A candidate that would stay short of T on all long lists is not probed.
    """
    for b in batches:
        n, size_a, size_b = (b.column(x).to_numpy().astype(np.int64) for x in ("n", "size_a", "size_b"))
        long, theirs = b.column("long"), b.column("tokens")
        need = np.ceil((size_a + size_b) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
        for i in np.flatnonzero(n + np.diff(long.offsets.to_numpy()) >= need):
            mine, other = np.asarray(long[int(i)].values), np.asarray(theirs[int(i)].values)
            if len(mine):
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                n[i] += int((other[at] == mine).sum())
        ok = np.flatnonzero(n >= need)
        rows = b.take(pa.array(ok))
        yield pa.RecordBatch.from_arrays([rows.column("key_a"), rows.column("key_b"), pa.array(n[ok].astype(np.int32)), rows.column("size_a"), rows.column("size_b")], ["key_a", "key_b", "overlap", "size_a", "size_b"])


class NearDuplicates:
    """Result of :func:`near_duplicates`.

    ``members``: ``id, key``, one row per record that has enough tokens; records with equal
    token sets share a key. ``links``: ``key_a, key_b, overlap, size_a, size_b``, every pair of
    different token sets that are similar enough.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """``id_a, id_b`` (smaller first) of all similar records, copies included."""
        m = self.members
        a, b = m.select(F.col("key").alias("key_a"), F.col("id").alias("x")), m.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
        apart = self.links.select("key_a", "key_b").join(a, "key_a").join(b, "key_b").select("x", "y")
        copied = m.join(m.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
        alike = copied.select("key", F.col("id").alias("x")).join(copied.select("key", F.col("id").alias("y")), "key").where("x < y").select("x", "y")
        return apart.unionByName(alike).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """``id, class_id, group_id, n_links``: one row per record.

        ``class_id`` is the smallest id with the same token set, ``group_id`` the smallest id
        reached over links, ``n_links`` the number of other token sets the record's set is
        similar to. Copies are not expanded into pairs.
        """
        classes = materialize(self.members.groupBy("key").agg(F.min("id").alias("class_id")), "classes")
        named = (
            self.links.join(classes.select(F.col("key").alias("key_a"), F.col("class_id").alias("a")), "key_a")
            .join(classes.select(F.col("key").alias("key_b"), F.col("class_id").alias("b")), "key_b")
            .select("a", "b")
        )
        named = materialize(named, "links")
        degree = named.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        groups = connected_components(named, "a", "b").select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
        return (
            self.members.join(classes, "key")
            .join(degree, "class_id", "left")
            .join(groups, "class_id", "left")
            .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )


def near_duplicates(
    records: DataFrame, id_col: str, text: Column, *, at: str | None = None, threshold: float = 0.8, shingle: int = 5, min_tokens: int = 1, short_hits: int = 2, long_list: int = LONG_LIST, partner_block: int = PARTNER_BLOCK
) -> NearDuplicates:
    """Records whose sets of word n-grams have at least ``threshold`` of their union in common.

    Words are the longest runs of ``A-Z a-z 0-9 _``, in lower case. All similar pairs are
    found (no sampling, no cap on partners); n-grams are compared by 64-bit hashes. Null
    ids or texts and texts with fewer than ``min_tokens`` words or no n-gram are left out. Of
    rows with the same id the one with the latest ``at`` counts. A list that many records
    share is streamed while it is measured; one longer than ``long_list`` that a record has to
    merge is split into blocks of at most about ``partner_block`` records, and so is the
    merge itself. A link names the larger set first (of equal ones the larger key).
    """
    rows = records.select(F.col(id_col).alias("id"), text.alias("text"), (F.col(at) if at else F.lit(None).cast("timestamp_ntz")).alias("at")).where("id is not null and text is not null")
    rows = spread(rows)
    id_type = dict(rows.dtypes)["id"]
    at_type = dict(rows.dtypes)["at"]
    members = rows.mapInArrow(partial(_members, n=shingle, min_tokens=min_tokens), f"id {id_type}, key long, size int, at {at_type}")
    members = materialize(members.groupBy("id").agg(F.max_by(F.struct("key", "size"), F.struct("at", "key")).alias("s")).select("id", "s.key", "s.size"), "members")

    tokens = rows.select("text").mapInArrow(partial(_tokens, n=shingle, min_tokens=min_tokens), "token long, key long")
    lists = tokens.repartition("token").sortWithinPartitions("token", "key").mapInArrow(partial(_lists, longest=long_list), "token long, key long, df int")
    sizes = members.groupBy("key").agg(F.first("size").alias("size"))
    need = F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    known = (
        lists.groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("lists"))
        .join(sizes, "key")
        .withColumn("hits", F.least(need, F.lit(short_hits)))
        # tokens on no other list come first in the order; they fill part of the short lists
        .withColumn("short", F.col("size") - need + F.col("hits") - (F.col("size") - F.size("lists")))
        .where("short >= hits")
        .select("key", "size", "hits", "short", "lists")
    )
    known = materialize(known, "lists")
    if_long = F.col("df") >= long_list
    posts = known.select("key", "size", "short", F.posexplode("lists").alias("_i", "l")).select("key", "size", "l.token", "l.df", (F.col("_i") < F.col("short")).alias("query"))
    # A list whose length is not known is split by blocks of partners, each seen by all records that ask for it.
    n_known = known.count()
    blocks = max(1, -(-n_known // partner_block))
    here = F.pmod(F.shiftrightunsigned("key", 33), F.lit(blocks)).cast("int")
    base = ["token", "size", "key"]
    few = posts.where(~if_long).select(*base, F.lit(-1).alias("cell"), "query", F.lit(True).alias("member"))
    many = posts.where(if_long)
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x.cast("int"))
    asking = many.where("query").select(*base, F.explode(cells).alias("cell"), F.lit(True).alias("query"), F.lit(False).alias("member"))
    held = many.select(*base, here.alias("cell"), F.lit(False).alias("query"), F.lit(True).alias("member"))
    order = ["token", "cell", "size", "key", F.desc("query")]  # a record asks before it is itself shown
    rows = few.unionByName(asking).unionByName(held).select("token", "cell", "size", "key", "query", "member")
    offers = rows.repartition("token", "cell").sortWithinPartitions(*order).mapInArrow(partial(_offers, threshold=threshold, blocks=blocks), "key long, block int, token long, partners array<long>")
    own = known.select("key", "size", "hits", F.slice(F.transform("lists", lambda x: x["token"]), F.col("short") + 1, F.size("lists")).alias("long"))
    own = own.select("key", F.explode(cells).alias("block"), "hits", "size", F.array().cast("array<long>").alias("partners"), "long")
    given = offers.select("key", "block", F.lit(0).alias("hits"), F.lit(0).alias("size"), "partners", F.array().cast("array<long>").alias("long"))
    merged = (
        own.unionByName(given)
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", F.desc("hits"))
        .mapInArrow(_merge, "key_a long, size_a int, key_b long, n int, long array<long>")
    )
    partners = known.select(F.col("key").alias("key_b"), F.col("size").alias("size_b"), F.sort_array(F.transform("lists", lambda x: x["token"])).alias("tokens"))
    met = merged.join(partners, "key_b").select("key_a", "key_b", "n", "size_a", "size_b", "long", "tokens")
    links = met.mapInArrow(partial(_probe, threshold=threshold), "key_a long, key_b long, overlap int, size_a int, size_b int")
    return NearDuplicates(members.select("id", "key"), materialize(links, "links"))
