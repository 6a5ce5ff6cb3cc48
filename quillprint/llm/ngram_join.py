"""Jaccard join of documents on word n-grams: grouped prefix join, and the components of its links.

Documents with equal n-gram sets are one class. A class's n-grams are put in a global order, rare ones first; two sets
whose Jaccard similarity reaches the threshold share an n-gram of their prefixes. Classes of equal prefix and size form a
group, and only groups are brought together by their prefix n-grams. Two groups whose first common n-gram stands so late
in a set that the rest is too short for the similarity are no pair; that also bounds what a passage of many documents
can bring together. Group pairs are then expanded to their members, whose whole sets are compared.

Copies by the thousand must not be paired with each other: what is asked for is which documents hang together, so each
bucket is first compared with one member only (a star, linear in the bucket): the one in whose set the common n-gram
stands first, which has least besides. A bucket whose members then hang together is done. In the others the members of
different components are compared, pair by pair, so no link is lost. Pairs are first held against signatures, whose
distance is never more than that of the sets. For the rest whole texts are fetched, compressed, each to the few places
where its pairs are compared.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.llm import grams
from quillprint.llm.components import components
from quillprint.session import discard, settle, ship_package

SHINGLE = 5
#: Similarity of 75 percent, in whole numbers.
PERCENT = 75
#: The order of n-grams only steers the work, not the result: n-grams that are in HOT documents come last. At most
#: HOT_KEPT of them, the most frequent, are sent to the tasks (12 bytes each).
HOT = 4
HOT_KEPT = 1 << 20
#: N-grams that are counted at once, about: a word and what separates it from the next are taken as WORD bytes. Counted
#: are the first bits of their hashes, so many more than number the n-grams; what agrees in these counts as one.
COUNTED = 1 << 20
WORD = 6
MORE_BITS = 7
#: Prefix n-grams of one bucket block.
BLOCK = 1 << 21
#: Where in its set an n-gram stands is known in such parts of the set, rounded down; LATEST stands for all from there on.
PARTS = 512
LATEST = 127
BROADCAST_IDS = 1 << 20
#: N-grams of the sets that one task holds at once to compare pairs.
PLACE = 1 << 19
#: Bits of a class's signature: the parity of how many of its n-grams fall on each.
SIGNATURE = 2048
#: The groups of a bucket of at most so many are paired at once; larger buckets get stars first.
SMALL = 8
#: Larger buckets get another star, with another member, as long as their members' pairs would be more than so many a row.
PAIRS_PER_ROW = 32
STARS = 2


def _sets(texts, n: int):
    """For each text the sorted distinct n-gram hashes; a text of fewer words is one n-gram, one without has none."""
    for first, last, data, offsets in grams.pieces(texts):
        hashes, bounds = grams.words(data, offsets, grams.SPACES)
        runs = grams.ngrams(hashes, n)
        for row in range(last - first):
            low, high = bounds[row], bounds[row + 1]
            if high - low >= n:
                yield first + row, np.unique(runs[low:high - n + 1])
            elif high > low:
                yield first + row, np.array([grams.whole(hashes[low:high])], np.uint64)
            else:
                yield first + row, np.empty(0, np.uint64)


def _fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a set: two sums of scrambled members."""
    a, b = grams.mix(values ^ np.uint64(0x5851F42D4C957F2D)), grams.mix(values + np.uint64(0x14057B7EF767814F))
    return (int(a.sum(dtype=np.uint64)) << 64 | int(b.sum(dtype=np.uint64))).to_bytes(16, "big")


def _signature(values: np.ndarray) -> np.ndarray:
    places = (values >> np.uint64(9)) & np.uint64(SIGNATURE - 1)
    odd = (np.bincount(places.astype(np.int64), minlength=SIGNATURE) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - (percent * size + 99) // 100 + 1


def _repeated(docs: DataFrame, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The n-grams of HOT documents or more, however these are dealt out: bits cut off from their hashes, the sorted
    rest, and the number of documents. Copies count once in what a task holds of them at once.

    Every task reports each n-gram that it has met, those of a range of hashes in a row; ranges add up the reports.
    """
    number = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD
    bits = min(max(32, number.bit_length() + MORE_BITS), 44)
    cut, ranges = 64 - bits, min(-(-number // COUNTED) or 1, 1 << 20)

    def report(batches):
        seen, found, size = set(), [], 0
        for batch in batches:
            for _, values in _sets(batch.column(0), n):
                mark = _fingerprint(values)
                if mark not in seen:
                    seen.add(mark)
                    found.append(values >> np.uint64(cut))
                    size += len(values)
            if size > 1 << 23:
                yield from counted(found)
                seen, found, size = set(), [], 0
        yield from counted(found)

    def counted(found):
        """A row per range: gaps between n-grams, first the lowest bytes of all, then the next, as most are small; which
        of them were met more than once, and how often."""
        if not found:
            return
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        ends = np.searchsorted(values * np.uint64(ranges) >> np.uint64(bits), np.arange(ranges + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(ends)):
            own, times = values[ends[i]:ends[i + 1]], counts[ends[i]:ends[i + 1]]
            gaps = np.diff(own, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6]
            often = np.flatnonzero(times > 1)
            every = [0, len(often)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), pa.array([gaps.T.tobytes()], pa.binary()),
                 pa.ListArray.from_arrays(every, often.astype(np.int32)),
                 pa.ListArray.from_arrays(every, times[often].astype(np.int32))], ["part", "gaps", "often", "times"])

    def added(reports: pa.Table) -> pa.Table:
        values, counts = [], []
        for row in range(reports.num_rows):
            gaps = np.frombuffer(reports.column("gaps")[row].as_py(), np.uint8).reshape(6, -1)
            wide = np.zeros((gaps.shape[1], 8), np.uint8)
            wide[:, :6] = gaps.T
            values.append(np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64))
            counts.append(np.ones(len(wide), np.int32))
            counts[-1][reports.column("often")[row].values.to_numpy()] = reports.column("times")[row].values.to_numpy()
        values, counts = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(values)
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.diff(values, prepend=values[0] + np.uint64(1)))
        sums = np.add.reduceat(counts.astype(np.int64), starts)
        often = sums >= HOT
        return pa.table({"gram": values[starts][often].view(np.int64), "n": sums[often]})

    rows = docs.select("text").mapInArrow(
        report, "part bigint, gaps binary, often array<int>, times array<int>").groupBy("part").applyInArrow(
        added, "gram bigint, n bigint")
    top = rows.orderBy(F.desc("n"), "gram").limit(HOT_KEPT).toArrow()
    values = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(values)
    return cut, values[order], top.column(1).to_numpy()[order].astype(np.int32)


def _ordered_prefix(values: np.ndarray, cut: int, hot: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    length = prefix_length(len(values), percent)
    if len(hot):
        known = values >> np.uint64(cut)
        at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
        often = np.where(hot[at] == known, counts[at], 0)
        if often.any():
            values = values[np.lexsort((values, often))]
    return values[:length]


def _group(prefix: np.ndarray, size: int) -> int:
    total = int(grams.mix(prefix).sum(dtype=np.uint64)) & (2**64 - 1)
    return int(grams.mix(np.array([(total + size * 0x9E3779B97F4A7C15) % 2**64], np.uint64)).view(np.int64)[0])


def _possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs that their signatures do not rule out. Similar sets differ in at most (a + b)(100 - p) / (100 + p)
    members, and signatures in no more bits than that."""
    left = signatures.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("sig").alias("sa"))
    right = signatures.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_alike("sa", "sb", "size_a", "size_b", percent)).select("a", "b")


def _alike(sig_a: str, sig_b: str, size_a: str, size_b: str, percent: int):
    bits = F.expr(f"aggregate(zip_with({sig_a}, {sig_b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return bits.cast("bigint") * (100 + percent) <= (F.col(size_a) + F.col(size_b)) * (100 - percent)


def _reach(size: str, late: str, other: str, percent: int):
    """Whether what a set has from its first common n-gram on is enough for the similarity with one of size ``other``."""
    return F.col(size) * (PARTS - F.col(late)) * (100 + percent) >= (F.col(size) + F.col(other)) * (PARTS * percent)


def _both_reach(a: str, late_a: str, b: str, late_b: str, percent: int):
    return _reach(a, late_a, b, percent) & _reach(b, late_b, a, percent)


def join_documents(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id``: size of each document's set, and the smallest key reachable by links.

    Words are what ASCII white space separates, A-Z lower-cased. Two documents link when 100 * intersection >= percent *
    union. A text without words, or null, has no set and links with nothing: its component is itself. Repeated rows stay;
    a null key never names a component unless all keys of the component are null.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hot = spark.sparkContext.broadcast(_repeated(docs, n))

    def describe(batches):
        for batch in batches:
            rows, signatures = [], []
            for _, values in _sets(batch.column(1), n):
                prefix = _ordered_prefix(values, *hot.value, percent) if len(values) else values
                rows.append((len(values), _fingerprint(values), _group(prefix, len(values))))
                signatures.append(_signature(values))
            words = SIGNATURE // 64
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.ListArray.from_arrays(
                     pa.array(np.arange(len(rows) + 1) * words, pa.int32()),
                     np.concatenate([np.empty(0, np.int64), *signatures]))], ["key", "size", "class", "grp", "sig"])

    kind = docs.schema["key"].dataType.simpleString()
    described = settle(docs.mapInArrow(describe, f"key {kind}, size bigint, class binary, grp bigint, sig array<bigint>"),
                       "join-documents")
    filled = described.where("size > 0")
    classes = settle(filled.groupBy("class").agg(F.first("size").alias("size"), F.first("grp").alias("grp"),
                                                 F.min("key").alias("key")), "join-classes")
    grams_total = filled.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-grams_total * (100 - percent) // 100 // BLOCK))

    def post(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            for _, values in _sets(batch.column(0), n):
                if not len(values):
                    continue
                prefix = _ordered_prefix(values, *hot.value, percent)
                group = _group(prefix, len(values))
                if group not in seen:
                    seen.add(group)
                    held.append((prefix, np.full(len(prefix), group, np.int64),
                                 np.full(len(prefix), len(values), np.int32)))
                    size += len(prefix)
            if size > 1 << 21:
                yield from dealt(held)
                held, size = [], 0
        yield from dealt(held)

    def dealt(held):
        """A row per block: half of each n-gram's hash (an equal half is one more pair to look at), how late it stands,
        as a negative number where another group begins, and the groups in this order."""
        if not held:
            return
        tokens, groups, sizes = (np.concatenate(x) for x in zip(*held))
        starts = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
        place = np.arange(len(tokens)) - np.repeat(starts, [len(x[0]) for x in held])
        late = np.minimum(place * PARTS // sizes, LATEST).astype(np.int8)
        block = (tokens >> np.uint64(32)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(blocks + 1))
        for i in np.flatnonzero(np.diff(ends)):
            own = order[ends[i]:ends[i + 1]]
            new = np.ones(len(own), bool)
            new[1:] = groups[own[1:]] != groups[own[:-1]]
            every, few = [0, len(own)], [0, int(new.sum())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int64()), pa.ListArray.from_arrays(every, tokens[own].astype(np.uint32).view(np.int32)),
                 pa.ListArray.from_arrays(every, np.where(new, ~late[own], late[own])),
                 pa.ListArray.from_arrays(few, groups[own[new]]), pa.ListArray.from_arrays(few, sizes[own[new]])],
                ["block", "tokens", "late", "groups", "sizes"])

    def shared(found: pa.Table) -> pa.Table:
        """Pairs ``grp, other`` of small buckets, rows ``token, grp, late`` of larger ones. A larger bucket is named by its
        groups, so that n-grams with the same groups (the words of one passage) are one bucket."""
        tokens, late, groups, sizes = (found.column(c).combine_chunks().flatten().to_numpy()
                                       for c in ("tokens", "late", "groups", "sizes"))
        own = np.cumsum(late < 0, dtype=np.int32) - 1
        late = np.where(late < 0, ~late, late)
        groups, of = np.unique(groups, return_inverse=True)
        size = np.zeros(len(groups), np.int64)
        size[of] = sizes
        own = of[own].astype(np.int32)
        order = np.lexsort((late, own, tokens))
        tokens, late, own = tokens[order], late[order], own[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
        tokens, late, own = tokens[new], late[new], own[new]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        run = np.cumsum(first, dtype=np.int32) - 1
        many = np.bincount(run)
        among = (many[run] > 1) & (many[run] <= SMALL)
        tokens_in, late_in, own_in = tokens[among], late[among].astype(np.int64), own[among]
        pairs = [np.empty((0, 2), np.int64)]
        for ahead in range(1, SMALL):
            a, b = slice(None, -ahead), slice(ahead, None)
            small, large = size[own_in[a]], size[own_in[b]]
            enough = (small + large) * (PARTS * percent)
            met = ((tokens_in[a] == tokens_in[b]) & (small * (PARTS - late_in[a]) * (100 + percent) >= enough)
                   & (large * (PARTS - late_in[b]) * (100 + percent) >= enough))
            pairs.append(np.column_stack([groups[own_in[a][met]], groups[own_in[b][met]]]))
        paired = np.unique(np.concatenate(pairs), axis=0)
        rest = many[run] > SMALL
        run, late, own = run[rest], late[rest], groups[own[rest]]
        names = np.zeros(len(many), np.uint64)
        np.add.at(names, run, grams.mix(own.view(np.uint64)))
        none = [pa.nulls(len(paired), pa.int64()), pa.nulls(len(run), pa.int64())]
        return pa.table({"token": pa.chunked_array([none[0], pa.array(grams.mix(names)[run].view(np.int64))]),
                         "grp": pa.chunked_array([pa.array(paired[:, 0]), pa.array(own)]),
                         "other": pa.chunked_array([pa.array(paired[:, 1]), none[1]]),
                         "late": pa.chunked_array([none[0].cast(pa.int8()), pa.array(late)])})

    posted = docs.select("text").mapInArrow(
        post, "block bigint, tokens array<int>, late array<tinyint>, groups array<bigint>, sizes array<int>")
    met = settle(posted.groupBy("block").applyInArrow(shared, "token bigint, grp bigint, other bigint, late tinyint"),
                 "join-met")
    hot.destroy()
    pairs = settle(met.where("token IS NULL").select("grp", "other").distinct(), "join-group-pairs")
    buckets = settle(met.where("token IS NOT NULL").groupBy("token", "grp").agg(F.min("late").cast("bigint").alias("late")),
                     "join-buckets")

    # Groups: their first class stands for them.
    groups = settle(classes.groupBy("grp").agg(F.min("class").alias("rep"), F.first("size").alias("size"),
                                               F.count(F.lit(1)).alias("members")), "join-groups")
    several = groups.where("members > 1").select("grp")
    named = buckets.select("grp").union(pairs.select("grp")).union(pairs.select("other")).union(several).distinct()
    needed = settle(classes.join(named, "grp", "left_semi").select("class", "grp", "size", "key"), "join-needed")
    signatures = settle(filled.select("class", "size", "sig").join(needed.select("class"), "class", "left_semi")
                        .dropDuplicates(["class"]), "join-signatures")

    def linked(pairs: DataFrame) -> DataFrame:
        possible = settle(_possible(pairs.distinct(), signatures, percent), "join-pairs")
        placed = settle(_placed(possible, needed), "join-places")
        texts = _needed_texts(docs, needed, placed, n)
        found = settle(_verified(placed, texts, n, percent), "join-links")
        discard(possible, placed)
        return found

    # Pairs of groups by their first classes; members with their group's first class; groups of a larger bucket with its
    # first group.
    reps = groups.select("grp", "rep", "size")
    direct = pairs.join(reps.select("grp", F.col("rep").alias("a")), "grp").join(
        reps.select(F.col("grp").alias("other"), F.col("rep").alias("b")), "other").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    inner = needed.join(groups.select("grp", "rep"), "grp").where("class <> rep").select(
        F.col("rep").alias("a"), F.col("class").alias("b"))
    large = settle(buckets.join(reps, "grp"), "join-large")
    first = large.groupBy("token").agg(F.min(F.struct("late", "rep", "size")).alias("first"))
    outer = large.join(first, "token").where((F.col("rep") != F.col("first.rep")) & _both_reach(
        "size", "late", "first.size", "first.late", percent))
    links = linked(direct.union(inner).union(outer.select(
        F.least("rep", "first.rep").alias("a"), F.greatest("rep", "first.rep").alias("b"))))
    labels = components(links)

    # What is open: larger buckets, groups of several members, and pairs with such a group, as far as their members do not
    # hang together. A pair of single members is decided.
    members = needed.select("class", "grp", "size")
    wide = pairs.join(several, "grp", "left_semi").union(
        pairs.join(several.withColumnRenamed("grp", "other"), "other", "left_semi").select("grp", "other")).distinct()
    wide = wide.select(F.xxhash64("grp", "other").alias("token"), F.explode(F.array("grp", "other")).alias("grp"))
    unknown = wide.union(several.select(F.col("grp").alias("token"), "grp")).withColumn("late", F.lit(0).cast("bigint"))
    rows = settle(buckets.union(unknown).join(members, "grp").select("token", "class", "size", "late"), "join-rows")
    # a row that does not reach the smallest set of its bucket has no partner there
    least = rows.groupBy("token").agg(F.min("size").alias("least"))
    rows = rows.join(least, "token").where(_reach("size", "late", "least", percent)).drop("least")
    for turn in range(STARS + 1):
        labelled = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class"))
        split = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("token").agg(
            F.count(F.lit(1)).alias("components"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).where(
            "components > 1")
        split = settle(split, "join-split")
        work = split.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not work[0]:
            break
        rows = settle(labelled.join(split.select("token"), "token", "left_semi"), "join-open")
        star = turn < STARS and work[1] > PAIRS_PER_ROW * work[0]
        if star:  # the member that a hash of this turn puts first, against the other components
            ranked = F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), "class", "size", "late", "component")
            first = rows.groupBy("token").agg(F.min(ranked).alias("first"))
            pairs = rows.join(first, "token").where((F.col("component") != F.col("first.component")) & _both_reach(
                "size", "late", "first.size", "first.late", percent))
            pairs = pairs.select(F.least("class", "first.class").alias("a"), F.greatest("class", "first.class").alias("b"))
        else:
            # signatures go along, so that only pairs that they do not rule out leave the join
            signed = rows.join(signatures.select("class", "sig"), "class")
            other = signed.select("token", F.col("class").alias("b"), F.col("size").alias("size_b"),
                                  F.col("late").alias("late_b"), F.col("component").alias("component_b"),
                                  F.col("sig").alias("sig_b"))
            pairs = signed.join(other, "token").where(
                (F.col("class") < F.col("b")) & (F.col("component") != F.col("component_b"))
                & _both_reach("size", "late", "size_b", "late_b", percent)
                & _alike("sig", "sig_b", "size", "size_b", percent)).select(F.col("class").alias("a"), "b")
        more = linked(pairs)
        found = not more.isEmpty()
        if found:
            links = links.union(more)
            labels = components(links)
        if not star:
            break
        rows = rows.select("token", "class", "size", "late")

    named = classes.select("class", F.col("key").alias("own")).join(
        labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("own").alias("component_id"))
    of_class = named.join(smallest, "component").select("class", "component_id")
    linked = filled.join(of_class, "class").select("key", "size", "component_id")
    alone = described.where("size = 0").select("key", "size", F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")


def _placed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``place, a, b``: where each pair is compared. Pairs that hang together have one place as long as their sets are
    at most PLACE n-grams; otherwise several, by their class of fewer pairs, so that only a star's centre is at many."""
    cluster = components(pairs).withColumnRenamed("node", "class")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    ends = settle(degree.join(cluster, "class").join(sizes.select("class", "size"), "class"), "join-ends")
    weight = ends.groupBy("component").agg(F.ceil(F.sum("size") / PLACE).alias("parts"))
    bins = -(-(ends.agg(F.sum("size")).first()[0] or 1) // PLACE)
    ends = ends.join(weight, "component")
    left = ends.select(F.col("class").alias("a"), F.col("degree").alias("degree_a"), "component", "parts")
    right = ends.select(F.col("class").alias("b"), F.col("degree").alias("degree_b"))
    fewer = F.when(F.col("degree_a") <= F.col("degree_b"), F.col("a")).otherwise(F.col("b"))
    part = F.pmod(F.xxhash64(fewer), F.col("parts"))
    return pairs.join(left, "a").join(right, "b").select(
        F.pmod(F.xxhash64("component", part), F.lit(bins)).alias("place"), "a", "b")


def _needed_texts(docs: DataFrame, needed: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """``at, class, packed``: the compressed text of a document of each class, wherever it is compared. A class may
    come more than once, from each task that holds a document with one of the keys."""
    places = placed.select(F.col("place").alias("at"), F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = needed.join(places.select("class"), "class", "left_semi")
    ids = needed.select("key").where("key IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = docs.join(ids, "key", "left_semi")
    if needed.where("key IS NULL").limit(1).count():
        wanted = wanted.union(docs.where("key IS NULL"))

    def pack(batches):
        seen = set()
        for batch in batches:
            names, found = [], []
            for row, values in _sets(batch.column(0), n):
                mark = _fingerprint(values)
                if len(values) and mark not in seen:
                    seen.add(mark)
                    names.append(mark)
                    found.append(zlib.compress(batch.column(0)[row].as_py().encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())],
                                             ["class", "packed"])

    return wanted.select("text").mapInArrow(pack, "class binary, packed binary").join(places, "class").select(
        "at", "class", "packed")


def _verified(placed: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets are similar enough."""
    def compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        packed = dict(zip(texts.column("class").to_pylist(), texts.column("packed").to_pylist()))
        sets = {}
        for name in packed:
            text = pa.array([zlib.decompress(packed[name]).decode()], pa.large_string())
            sets[name] = next(_sets(text, n))[1]
        a, b, alike = pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), []
        for x, y in zip(a, b):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            alike.append(both * 100 >= (len(sets[x]) + len(sets[y]) - both) * percent)
        return pairs.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return placed.groupBy("place").cogroup(texts.groupBy("at")).applyInArrow(compare, "a binary, b binary")


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """The documents whose key is their component's, so one of each group; those without words all stay."""
    found = join_documents(docs, n, percent, key)
    stay = found.where((F.col("component_id").eqNullSafe(F.col(key))) | (F.col("n_shingles") == 0)).select(key).distinct()
    kept = docs.join(stay.where(F.col(key).isNotNull()), key, "left_semi")
    return kept.union(docs.where(F.col(key).isNull()))


def digest_sql(n: int = SHINGLE, percent: int = PERCENT) -> str:
    grams_of = f"list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: " \
               f"array_to_string(w[i:i + {n - 1}], ' ')))"
    return rf"""
    WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE {grams_of} END AS g FROM split),
    sized AS (SELECT doc_id, len(g) AS n, g FROM sets),
    grams AS (SELECT doc_id, n, unnest(g) AS s FROM sized),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM documents
              UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
    SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sized s JOIN reach r USING (doc_id)
    GROUP BY 1, 2"""
