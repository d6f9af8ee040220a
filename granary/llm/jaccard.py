"""N-gram Jaccard join with several global orders, and its connected components.

Texts with equal sets of shingles become one node. Two sets that reach the threshold share
tokens in their prefixes under every global order of tokens, so:

1. The first order sorts tokens by hash, with those last that are frequent near the front.
2. Nodes with a least token in common under other orders are held against the smallest of
   them. Those that link to it form its star, with their distance to it, so that a large
   group of near copies is one star and not its pairs.
3. Stars that share prefix tokens under the first order are candidates, unless sizes and
   parity signatures already tell them apart or they are in one component by now. First each
   root meets only the one of another component that its signature is nearest to, as often as
   CONTRACTIONS says; then all candidates between components that are left. Their roots' sets
   pass the other orders' prefix filters, and only what is left is verified.
4. Jaccard distance obeys the triangle inequality: if two roots are farther apart than the
   threshold and both stars' radii, none of their members link. For the few pairs of stars
   in between, members are joined by their prefixes in the same way.

Sixty-four-bit hashes stand for words, shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import saved, scratch, table
from .words import LOWER, NOT_BLANK, U, grams, hashes, mixed, pieces, release, spans, text_bytes

SHARE = 3  #: tokens that two prefixes must share
ORDERS = (U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179))  #: of the filters before verification
SEEDS = (U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B), U(0x3C6EF372FE94F82B), U(0xA54FF53A5F1D36F1))
FREQUENT = 1 << 20  #: at most so many tokens are told to every task as frequent
DENSE = 16  #: ids that share a token beyond which their parity signatures are held against each other first
BITS = 512  #: of a parity signature
PAIRS_AT_ONCE = 4096  #: pairs of one node that meet in one task, about
DEPUTIES = 8  #: members of a star that stand for it before all of them do
CONTRACTIONS = 1  #: times that each root is held against the nearest of another component
BEFORE = 4  #: earlier tokens by which a pair is known to have met already
MEET = 4096  #: ids that share a token beyond which they are dealt to parts, which meet two by two
SENT = 16 << 20  #: up to about so many bytes of ids are sent to every task; more are joined by a shuffle


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, as one ragged array, and where each begins."""
    data, off = text_bytes(texts)
    data = LOWER.take(data, mode="clip")
    s, e, owner = spans(data, off, NOT_BLANK)
    words = hashes(data, s, e)
    found, at = grams(words, owner, n)
    text = owner[at]
    count = np.bincount(owner, minlength=len(texts))
    short_texts = np.flatnonzero((count > 0) & (count < n))
    for m in range(1, n):  # a text of fewer words is one shingle
        short = np.flatnonzero(count == m)
        if len(short):
            first = np.searchsorted(owner, short)
            h = np.full(len(short), m, np.uint64)
            for i in range(m):
                h = mixed(h * U(0xD6E8FEB86659FD93) + words[first + i])
            found, text = np.r_[found, h], np.r_[text, short]
    if len(short_texts):
        order = np.argsort(text, kind="stable")
        found, text = found[order], text[order]
    sort_rows(found, np.searchsorted(text, np.arange(len(texts) + 1)))
    keep = np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])] if len(found) else np.zeros(0, bool)
    found, text = found[keep], text[keep]
    return found, np.searchsorted(text, np.arange(len(texts) + 1))


def sort_rows(values: np.ndarray, start: np.ndarray) -> None:
    """Sort each row of a ragged array in place; a row's own sort is far cheaper than one by two keys."""
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()


def prefix_length(n: np.ndarray, percent: int, share: int) -> np.ndarray:
    """Tokens of which two sets that reach percent share `share` at least, or all if they have fewer."""
    return np.minimum(n, n - (percent * n + 99) // 100 + share)


def nodes_of(found: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.r_[U(0), np.cumsum(mixed(found))]
    other = np.r_[U(0), np.cumsum(mixed(found ^ U(0x510E527FADE682D1)))]
    return mixed(mixed(total[start[1:]] - total[start[:-1]]) ^ (other[start[1:]] - other[start[:-1]]) ^ np.diff(start).astype(np.uint64))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def _rows(start: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(start) - 1), np.diff(start))


def frequent_tokens(docs: DataFrame, n: int, percent: int, share: int) -> np.ndarray:
    """The tokens that stand near the front of most sets in order of hash, at most FREQUENT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found, start = shingle_sets(part.column("text"), n)
                size = np.diff(start)
                near = np.arange(len(found)) - start[:-1][_rows(start)] < (prefix_length(size, percent, share) * 5 // 4 + 8)[_rows(start)]
                token, count = np.unique(found[near], return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(token), pa.array(count, pa.int64())], ["token", "n"])

    counted = saved(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 32"), "tokens")
    steps = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()  # a row for each power of two
    least, total = 64, 0
    for power, count in sorted(((r["power"], r["count"]) for r in steps), reverse=True):
        total += count
        if total > FREQUENT:
            break
        least = 1 << power
    return np.sort(counted.filter(F.col("n") >= least).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def signatures(found: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each set, of each of BITS classes of tokens whether it holds an odd number, packed."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(start) - 1, 2048):
        own = start[lo : lo + 2049]
        odd = np.bincount(_rows(own) * BITS + (found[own[0] : own[-1]] & U(BITS - 1)).astype(np.int64), minlength=(len(own) - 1) * BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.uint64))
    return np.concatenate(out)


def members(found: np.ndarray, last: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Which of found are in the sorted array last; maybe: a table by low bits that rules most others out."""
    out = maybe[found & U(len(maybe) - 1)]
    at = np.flatnonzero(out)
    if len(at):
        out[at] = last[np.minimum(np.searchsorted(last, found[at]), len(last) - 1)] == found[at]
    return out


def sketches(docs: DataFrame, n: int, percent: int, share: int, least_size: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, text_hash, node, n, least (of each seed), prefix (under the first order), parity.

    parity has for each of BITS classes of tokens whether the set holds an odd number; where
    two signatures differ, the sets differ in at least a token each.
    """
    told = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = told.value
        maybe = np.zeros(1 << 24, bool)
        maybe[last & U((1 << 24) - 1)] = True
        for batch in batches:
            for part in pieces(batch):
                found, start = shingle_sets(part.column("text"), n)
                size, row = np.diff(start), _rows(start)
                common = members(found, last, maybe)
                # A token's place in its row under the first order: the others first, then those that are frequent.
                before = np.r_[0, np.cumsum(common)]
                own = before[:-1] - before[start[:-1]][row]
                others = np.arange(len(found)) - start[:-1][row] - own
                place = np.where(common, (size - (before[start[1:]] - before[start[:-1]]))[row] + own, others)
                keep = place < np.where(size >= least_size, prefix_length(size, percent, share), 0)[row]
                prefix = found[keep]
                offsets = np.searchsorted(row[keep], np.arange(len(size) + 1)).astype(np.int32)
                least = np.zeros((len(SEEDS), len(size)), np.uint64)
                if len(found):
                    full = size > 0
                    for i, seed in enumerate(SEEDS):
                        least[i, full] = np.minimum.reduceat((found ^ seed) * (seed | U(1)), start[:-1][full])
                parity = signatures(found, start)
                parity = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (BITS // 64)), _long(parity))
                lists = pa.ListArray.from_arrays(pa.array(offsets), _long(prefix))
                seeds = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(SEEDS)), _long(least.T.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), _long(nodes_of(found, start)), pa.array(size, pa.int32()), seeds, lists, parity], ["doc_id", "text_hash", "node", "n", "least", "prefix", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, node long, n int, least array<long>, prefix array<long>, parity array<long>")


def _small(ids: DataFrame) -> DataFrame:
    """ids: node, doc_id, text_hash, to. Sent to every task if few, by the bytes that they take there."""
    told = ids.agg(F.sum(64 + 32 * F.size("to"))).first()[0] or 0
    return F.broadcast(ids) if told <= SENT else ids


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs: a, b, strict. Returns a, b, distance; strict pairs that fail a filter are left out.

    A strict pair matters only if it links, so it must share prefix tokens under every other
    order before its sets are intersected. Only sets of nodes in pairs are made again from
    their texts; each moves once for each pair that it is the second of, to where the first
    is, and a first with many pairs is dealt out with copies of it. A second of many pairs
    comes in several rows, so that no list grows with a group.
    """
    each = lambda key, by: (F.row_number().over(Window.partitionBy(key).orderBy(by)) - 1)
    numbered = pairs.withColumn("r", each("a", "b")).withColumn("part", F.floor(F.col("r") / PAIRS_AT_ONCE).cast("int"))
    to = lambda place, strict: F.struct(F.col("a").alias("key"), "part", F.lit(place).alias("place"), strict.alias("strict")).alias("to")
    seconds = numbered.select(F.col("b").alias("node"), to(1, F.col("strict")))
    firsts = numbered.filter(F.col("r") % PAIRS_AT_ONCE == 0).select(F.col("a").alias("node"), to(0, F.lit(False)))
    sent = seconds.unionByName(firsts).withColumn("list", F.floor(each("node", "to") / PAIRS_AT_ONCE))
    sent = sent.groupBy("node", "list").agg(F.collect_list("to").alias("to"))
    needed = saved(sent.join(nodes.select("node", "rep"), "node").select("node", "rep.doc_id", "rep.text_hash", "to"), "needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most=1 << 20):
                found, start = shingle_sets(part.column("text"), n)
                size, row = np.diff(start), _rows(start)
                columns = [pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), _long(found))]
                for order in ORDERS:
                    h = (found ^ order) * (order | U(1))
                    sort_rows(h, start)
                    keep = np.arange(len(h)) - start[:-1][row] < prefix_length(size, percent, 1)[row]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[keep], np.arange(len(size) + 1)).astype(np.int32)), _long(h[keep])))
                to = part.column("to")
                of = np.repeat(np.arange(part.num_rows), np.diff(to.offsets.to_numpy()))
                flat = to.flatten()
                for few in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(size[of]) >> 19)) + 1):  # about 4 MB of tokens each
                    take = pa.array(of[few])
                    told = [flat.field(f).take(pa.array(few)) for f in ("key", "part", "place", "strict")]
                    yield pa.RecordBatch.from_arrays([*told, part.column("node").take(take), *[c.take(take) for c in columns]], ["key", "part", "place", "strict", "node", "tokens", *fronts])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # of the key and part that stand now: the first's lists
        for batch in batches:
            key, part, place = (batch.column(c).to_numpy() for c in ("key", "part", "place"))
            lists = [_ragged(batch.column(c)) for c in ("tokens", *fronts)]
            begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (place[1:] != place[:-1])]) if len(key) else []
            for lo, hi in zip(begins, np.r_[begins[1:], len(key)] if len(key) else [], strict=True):
                if place[lo] == 0:
                    first = [values[start[lo] : start[lo + 1]] for values, start in lists]
                    continue
                # The other orders' prefixes tell which pairs' sets are intersected at all.
                keep = np.ones(hi - lo, bool)
                for own, (values, start) in zip(first[1:], lists[1:], strict=True):
                    keep &= _shared(own, values[start[lo] : start[hi]], start[lo : hi + 1] - start[lo]) > 0
                keep |= ~batch.column("strict").to_numpy(zero_copy_only=False)[lo:hi]
                values, start = lists[0]
                size = np.diff(start[lo : hi + 1])[keep]
                left = values[start[lo] : start[hi]][np.repeat(keep, np.diff(start[lo : hi + 1]))]
                shared = _shared(first[0], left, np.r_[0, np.cumsum(size)])
                distance = 1 - shared / (len(first[0]) + size - shared)
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi][keep]), pa.array(batch.column("node").to_numpy()[lo:hi][keep]), pa.array(distance)], ["a", "b", "distance"])
        first = None
        release()

    fronts = [f"front{i}" for i in range(len(ORDERS))]
    ids = _small(needed)
    chosen = docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("d.text_hash") == F.col("i.text_hash"))).select("i.node", "i.to", "d.text")
    held = chosen.mapInArrow(sets, "key long, part int, place int, strict boolean, node long, tokens array<long>, " + ", ".join(f"{f} array<long>" for f in fronts))
    met = held.repartition("key", "part").sortWithinPartitions("key", "part", "place").mapInArrow(compare, "a long, b long, distance double")
    # Rows that repeat an id and a text are one node; then a pair can come several times.
    return saved(met.dropDuplicates(["a", "b"]), "verified")


def _ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    start = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy().view(np.uint64), start - start[0]


def _shared(own: np.ndarray, values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of each row's values are in own, which is sorted."""
    if not len(own):
        return np.zeros(len(start) - 1, np.int64)
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    total = np.r_[0, np.cumsum(hit)]
    return total[start[1:]] - total[start[:-1]]


def by_token(work, rows_at_once: int = 50_000):
    """For mapInArrow over rows sorted by token: gives work the rows of whole tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows_at_once:
                continue
            t = pa.Table.from_batches(held)
            token = t.column("token").to_numpy()
            whole = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
            if whole:
                yield from work(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                n -= whole
        if held:
            yield from work(pa.Table.from_batches(held))
        del held
        release()

    return run


def each_pair(token: np.ndarray, stay) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of one token, each row with the next, then the one after, and so on.

    stay(x, y) tells which of the rows x go on after they met y.
    """
    end = np.searchsorted(token, token, side="right")
    x = np.arange(len(token))
    step = 1
    while len(x := x[x + step < end[x]]):
        yield x, x + step
        x = x[stay(x, x + step)]
        step += 1


def shared_tokens(placed: DataFrame, percent: int) -> DataFrame:
    """a, b, token of stars that share a prefix token; for a token of many stars a row each, with b null.

    placed: root, n, prefix of each node. Rows of one star in a batch are merged before the
    shuffle. Sizes that the threshold can't reach make no pair.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            yield from merged(token, batch.column("root").to_numpy()[row], *[batch.column("n").to_numpy()[row]] * 2)

    def least_and_most(token: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((own, token))
        token, own, low, high = token[order], own[order], low[order], high[order]
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])]) if len(token) else np.zeros(0, np.int64)
        if not len(first):
            return token, own, low, high
        return token[first], own[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

    def merged(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in least_and_most(*columns)], ["token", "id", "low", "high"])

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token, own, low, high = least_and_most(*(t.column(c).to_numpy() for c in ("token", "id", "low", "high")))
        order = np.lexsort((low, token))
        token, own, low, high = token[order], own[order], low[order], high[order]
        many = np.searchsorted(token, token, side="right") - np.searchsorted(token, token) > DENSE
        yield pa.RecordBatch.from_arrays([pa.array(own[many]), pa.nulls(int(many.sum()), pa.int64()), pa.array(token[many])], ["a", "b", "token"])
        token, own, low, high = token[~many], own[~many], low[~many], high[~many]
        fits = lambda x, y: percent * low[y] <= 100 * high[x]  # noqa: E731  the rows after y are larger still
        for x, y in each_pair(token, fits):
            ok = fits(x, y)
            if ok.any():
                x, y = own[x[ok]], own[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "token"])

    rows = placed.select("root", "n", "prefix").mapInArrow(merge, "token long, id long, low int, high int")
    return saved(rows.repartition("token").sortWithinPartitions("token").mapInArrow(by_token(meet), "a long, b long, token long"), "met")


def dense_pairs(dense: DataFrame, info: DataFrame, limit: float, nearest: bool) -> DataFrame:
    """a, b, distance of stars of different components that share a token of many stars.

    info: id, n, radius, parity, label. A pair comes at the first token that the two share, and
    again only where more than BEFORE of their other tokens lie between two that they share; not
    at all if the signatures show that its roots are farther apart than the threshold and
    their radii. nearest: of each
    star only the pair with the nearest other root, as far as signatures tell and the threshold
    reaches. dense: see dealt_tokens.
    """

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token, own, n, radius, label, part = (t.column(c).to_numpy() for c in ("token", "id", "n", "radius", "label", "part"))
        parity = t.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(token), -1)
        order = np.lexsort((n, token))
        token, own, n, radius, label, part, parity = (c[order] for c in (token, own, n, radius, label, part, parity))
        one_part = t.column("one_part").to_numpy()[order]
        if not nearest:
            lists = t.column("before").combine_chunks()
            held = np.diff(lists.offsets.to_numpy())
            before, known = np.zeros((len(token), BEFORE), np.int64), np.arange(BEFORE) < held[:, None]
            before[known] = lists.flatten().to_numpy()
            before, known = before[order], known[order]
        reach = np.zeros(len(n)) if nearest else radius
        more = 0.0 if nearest else limit
        best, to = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
        apart = lambda differ, x, y: 2 * differ / (n[x] + n[y] + differ)  # noqa: E731  the least distance
        for x, y in each_pair(token, lambda x, y: apart(n[y] - n[x], x, y) <= limit + reach[x] + more):
            meets = (label[x] != label[y]) & (one_part[x] | (part[x] != part[y]))
            x, y = x[meets], y[meets]
            differ = np.maximum(np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64), n[y] - n[x])
            distance = apart(differ, x, y)
            ok = distance <= limit + reach[x] + reach[y]
            x, y, distance = x[ok], y[ok], distance[ok]
            if not nearest:
                again = ((before[x][:, :, None] == before[y][:, None, :]) & known[x][:, :, None] & known[y][:, None, :]).any(axis=(1, 2))
                yield told(own[x[~again]], own[y[~again]], distance[~again])
                continue
            for u, v in ((x, y), (y, x)):
                nearer = distance < best[u]
                best[u[nearer]], to[u[nearer]] = distance[nearer], own[v[nearer]]
        if nearest:
            found = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(to[found]), pa.array(own[found]), pa.array(best[found])], ["a", "b", "distance"])

    def told(x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(distance)], ["a", "b", "distance"])

    rows = dense.join(info, "id").select("token", "id", "n", "radius", "label", "part", "one_part", "parity", *([] if nearest else ["before"]))
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(by_token(meet), "a long, b long, distance double")


def dealt_tokens(met: DataFrame) -> DataFrame:
    """id, token, part, one_part, before: the stars of tokens of many; of more than MEET, by pairs of parts, which token then names.

    before: the BEFORE tokens of many that the star has before this one.
    """
    dense = met.filter("b is null").select(F.col("a").alias("id"), "token")
    dense = dense.withColumn("before", F.collect_list("token").over(Window.partitionBy("id").orderBy("token").rowsBetween(-BEFORE, -1)))
    hot = saved(dense.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts")).filter("parts > 1"), "hot")
    hot = F.broadcast(hot) if 64 * hot.count() <= SENT else hot
    dealt = dense.join(hot, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A part meets every other part; within itself it meets where both are the same.
    return saved(dealt.select("id", F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")).alias("token"), "part", (F.col("part") == F.col("other")).alias("one_part"), "before"), "dense")


def nearest_pairs(dense: DataFrame, info: DataFrame, limit: float) -> DataFrame:
    """a, b, strict: each star with the star of another component that is nearest to it."""
    found = dense_pairs(dense, info, limit, True).groupBy("b").agg(F.min(F.struct("distance", "a"))["a"].alias("a"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("strict")).distinct()


def prefix_pairs(met: DataFrame, dense: DataFrame, info: DataFrame, share: int, limit: float) -> DataFrame:
    """Pairs a < b of stars of different components whose members share `share` prefix tokens, or one of many stars, and the sum of their radii, slack."""
    few = met.filter("b is not null").select("a", "b", F.lit(1).alias("shared"))
    many = dense_pairs(dense, info, limit, False).select("a", "b", F.lit(share).alias("shared"))
    pairs = few.unionByName(many).groupBy("a", "b").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= share).select("a", "b")
    ia, ib = (info.select(*[F.col(c).alias(f"{c}_{k}") for c in info.columns]) for k in "ab")
    pairs = pairs.join(ia, F.col("a") == F.col("id_a")).join(ib, F.col("b") == F.col("id_b")).filter("label_a <> label_b")
    return pairs.filter(least_distance("a", "b") <= limit + F.col("radius_a") + F.col("radius_b")).select("a", "b", (F.col("radius_a") + F.col("radius_b")).alias("slack"))


def least_distance(a: str, b: str):
    """The least Jaccard distance that sizes and parity signatures (n_a, parity_a, ...) leave possible."""
    differ = sum((F.bit_count(F.col(f"parity_{a}")[i].bitwiseXOR(F.col(f"parity_{b}")[i])) for i in range(BITS // 64)), F.lit(0))
    differ = F.greatest(differ, F.abs(F.col(f"n_{a}") - F.col(f"n_{b}")))
    return 2 * differ / (F.col(f"n_{a}") + F.col(f"n_{b}") + differ)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, label: the smallest node that it reaches. Loops alone make no row.

    Large and small stars in turn: each node hands its greater neighbours, then its smaller
    ones, to the least that it sees. Edges never grow in number, and end as stars around the
    least nodes after rounds whose number grows with the logarithm of the nodes, for paths too.
    Each round is written; rounds end when one changes nothing.
    """
    edges = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")]
    before = edges.agg(*told).first().asDict()
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        now = Observation()  # of the write; a task that ran twice could at most cost one more round
        after = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct()
        edges = saved(after.observe(now, *told), "edges")
        now = now.get
        if now == before:
            break
        before = now
    least = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return saved(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(least), "labels")


def deputy_pairs(gray: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of one star's root with a few members of the other's.

    In a large group of near copies most roots in doubt link to one of them, which settles
    the question; only for the rest all members are searched.
    """
    w = Window.partitionBy("root").orderBy(F.xxhash64("node"), "node")
    few = placed.filter("node <> root").select("root", "node").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= DEPUTIES)
    one = gray.join(few, gray["a"] == few["root"]).select(F.col("b").alias("x"), F.col("node").alias("y"))
    two = gray.join(few, gray["b"] == few["root"]).select(F.col("a").alias("x"), F.col("node").alias("y"))
    return one.unionByName(two).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(True).alias("strict")).distinct()


def member_pairs(gray: DataFrame, label: DataFrame, placed: DataFrame, percent: int, share: int, limit: float) -> DataFrame:
    """Pairs of members of stars whose roots are too far apart to link and too close to tell.

    Stars that already are in one component need no further link. Members must share prefix
    tokens, and their distances to their roots must bridge the distance of the roots.
    """
    la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    apart = gray.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "distance")
    apart = saved(apart, "apart")
    asked = apart.select(F.explode(F.array("a", "b")).alias("root")).distinct()
    member = saved(placed.join(asked, "root").select("root", "node", "n", "radius", "parity", F.explode("prefix").alias("token")), "members")
    x = apart.join(member, apart["a"] == member["root"]).select("b", "distance", "token", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("radius").alias("rx"), F.col("parity").alias("parity_x"))
    y = member.select(F.col("root").alias("b"), "token", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("radius").alias("ry"), F.col("parity").alias("parity_y"))
    near = (F.col("rx") + F.col("ry") + limit >= F.col("distance")) & (least_distance("x", "y") <= limit)
    both = x.alias("l").join(y.alias("r"), (F.col("l.b") == F.col("r.b")) & (F.col("l.token") == F.col("r.token")) & near).groupBy("x", "y").count().filter(F.col("count") >= share)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    docs: doc_id, text. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, shingles n words; a
    text of fewer words is one shingle, a text without words has none and links with nothing.
    Two texts link when their sets' Jaccard similarity reaches percent / 100. component_id is
    the smallest doc_id reachable by links. Rows that repeat a doc_id are documents of their
    own; a null doc_id is never the smallest unless all are null. Other columns are ignored.
    """
    with scratch():
        return saved(_similar(docs, n, percent).select("doc_id", "n_shingles", "component_id"), "similar", keep=True)


def superfluous_documents(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash of the rows of docs for which another row of their component stands.

    The row that stands for a component has the smallest doc_id, nulls last, then the smallest
    text_hash. Ids alone don't tell: they can be null, and different texts can repeat one.
    """
    with scratch():
        found = _similar(docs, n, percent).filter("n_shingles > 0")
        stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        return saved(found.filter(~stands).select("doc_id", "text_hash").distinct(), "superfluous", keep=True)


def _similar(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first, the row that stands for the component."""
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    # Smaller sets reach the threshold with equal sets only, and those are one node.
    least_size = max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 30
    share = min(SHARE, -(-percent * least_size // 100))
    limit = 1 - percent / 100 + 1e-12
    sketch = saved(sketches(docs, n, percent, share, least_size, frequent_tokens(docs, n, percent, share)), "sketch")
    nodes = saved(sketch.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first"), F.min("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("rep")), "nodes")
    large = saved(sketch.filter(F.col("n") >= least_size).select("node", "n", "least", "prefix", "parity").dropDuplicates(["node"]), "large")
    check = lambda pairs: verified(pairs, nodes, docs, n, percent)

    # Stars.
    own = lambda k: F.struct("node", "n", "parity").alias(k)
    buckets = large.select("node", "n", "parity", F.posexplode("least").alias("seed", "token"))
    pivots = buckets.groupBy("seed", "token").agg(F.min(own("p")).alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("seed", "token", "p.node", "p.n", "p.parity")
    pivots = pivots.select("seed", "token", *[F.col(c).alias(f"{c}_p") for c in ("node", "n", "parity")])
    near = buckets.join(pivots, ["seed", "token"]).filter("node <> node_p").withColumnsRenamed({"n": "n_x", "parity": "parity_x"})
    near = near.filter(least_distance("p", "x") <= limit).select(F.col("node_p").alias("a"), F.col("node").alias("b")).distinct()
    linked = check(near.withColumn("strict", F.lit(True))).filter(F.col("distance") <= limit)
    inner = linked.select(F.col("b").alias("a")).distinct()  # they link to a smaller pivot, so they are no roots
    roots = linked.join(inner, "a", "left_anti").groupBy("b").agg(F.min(F.struct("distance", "a")).alias("m")).select(F.col("b").alias("node"), F.col("m.a").alias("root"), F.col("m.distance").alias("radius"))
    placed = large.join(roots, "node", "left").select("node", "n", "prefix", "parity", F.coalesce("root", "node").alias("root"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    placed = saved(placed, "placed")

    # Stars against stars.
    reach = placed.groupBy("root").agg(F.max("radius").alias("radius")).withColumnRenamed("root", "id")
    info = saved(placed.filter("node = root").select(F.col("node").alias("id"), "n", "parity").join(reach, "id"), "roots")
    met = shared_tokens(placed, percent)
    dense = dealt_tokens(met)
    label = components(linked.select("a", "b"))
    grown = lambda more: components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more.filter(F.col("distance") <= limit).select("a", "b")))
    labelled = lambda: info.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    for _ in range(CONTRACTIONS):
        label = grown(check(nearest_pairs(dense, labelled(), limit)))
    pairs = saved(prefix_pairs(met, dense, labelled(), share, limit), "pairs")
    between = check(pairs.select("a", "b", (F.col("slack") == 0).alias("strict")))
    label = grown(between)
    gray = between.filter(F.col("distance") > limit).join(pairs, ["a", "b"]).filter(F.col("distance") <= limit + F.col("slack"))
    gray = saved(gray.select("a", "b", "distance"), "gray")
    if not gray.isEmpty():
        label = grown(check(deputy_pairs(gray, placed)))
        label = grown(check(member_pairs(gray, label, placed, percent, share, limit).withColumn("strict", F.lit(True))))

    # Components, and the smallest document of each.
    named = nodes.join(label, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("first"))
    of_node = named.select("node", "label").join(smallest, "label").select("node", "first")
    told = sketch.select("doc_id", "text_hash", "node", F.col("n").cast("long").alias("n_shingles"))
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return told.join(of_node, "node", "left").select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "first")


def op5_jaccard_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM d
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
few AS (SELECT g FROM t GROUP BY g HAVING COUNT(*) > 1),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, ANY_VALUE(a.n) AS nx, ANY_VALUE(b.n) AS ny, COUNT(*) AS n_both
  FROM t a JOIN few USING (g) JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * LEAST(a.n, b.n) >= 90 * GREATEST(a.n, b.n) GROUP BY 1, 2
), link AS (SELECT x, y FROM pair WHERE 100 * n_both >= 90 * (nx + ny - n_both)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  WITH RECURSIVE r AS (SELECT DISTINCT x AS doc_id, x AS c FROM edge UNION SELECT e.y, r.c FROM r JOIN edge e ON r.doc_id = e.x WHERE r.c < e.y)
  SELECT doc_id, MIN(c) AS c FROM r GROUP BY doc_id
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, LEAST(s.doc_id, COALESCE(c, s.doc_id)) AS component_id FROM s LEFT JOIN reach USING (doc_id)
"""
