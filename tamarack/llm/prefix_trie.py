"""Trie of conversation prefixes by composable fingerprints, without building the rebuilt conversations.

Each conversation is rebuilt from the head of another one and its own later turns. The fingerprint of a sequence of turns
is a sum of ``turn * base^place`` modulo three primes below 2^31, so sequences form a monoid: two fingerprints join by one
multiplication with a power, and a stretch's fingerprint is the difference of two prefix sums. The stored turns are scanned
once for prefix sums; the fingerprint of any prefix of a rebuilt conversation is then an expression of the sum of the other
conversation's head and of two sums of its own turns. No text is read after the scan's projection.

A prefix group (depth, fingerprint) is a node once it is verified: all members' last turns, referred to by the SHA-256 of
role and text that is stored with each turn, are equal. As equal fingerprints with equal last turns leave equal fingerprints
of the turns before, this proves by induction that whole prefixes are equal. A group that fails makes ``nodes`` begin anew with
other bases.

Subtree sums need no walk down the trie. A member owns those of its nodes whose smallest member it is, and these are its
deepest ones. So the leaves below a node are its members that own a leaf, its children are its members that own a node one
deeper, and the bytes saved below it are, summed over members, the bytes of their turns from its depth to the first owned one.

Conversations of any length and groups of any size are spread: the scan deals turns by ranges of (conversation, turn), and
one row for each partition carries sums over the borders. Ends of a node are listed in pieces before they are hashed in order.

Turns are ordered by ``turn``, null first, those of equal turn by their digest; repeated rows are repeated turns. A null
role or text is empty. Rows without a conv_id belong to no conversation and are left out. No rows give no nodes. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

PRIMES = (2147483629, 2147483587, 2147483579)
MOST_HEAD = 8
KEY = ("depth", "fa", "fb")
_SUMS, _TERMS, _DIGEST = ("s0", "s1", "s2"), ("t0", "t1", "t2"), ("d0", "d1", "d2", "d3")
_SCANNED = "pid int, conv_id long, place long, bytes long, cum long, " + ", ".join(f"{c} long" for c in _SUMS + _TERMS + _DIGEST)
_EMPTY = hashlib.sha256().hexdigest()


def bases(seed: int) -> list[int]:
    """A base for each prime, drawn by the seed."""
    return [2 + int.from_bytes(hashlib.sha256(f"{seed}:{p}".encode()).digest()[:8], "little") % (p - 3) for p in PRIMES]


def head_of(conv_id: Column) -> Column:
    """Whose first turns a conversation begins with."""
    return conv_id - F.pmod(conv_id, F.lit(5))


def head_turns(conv_id: Column) -> Column:
    """How many of the head's turns it begins with, ``MOST_HEAD`` at most; as many of its own are passed over."""
    return F.crc32(conv_id.cast("string")) % 9


def _scan(base: list[int]):
    """Place, prefix sums and bytes of each turn inside its conversation, as far as this partition's rows go."""

    def run(batches):
        context, conv, place, cum, sums = TaskContext.get(), None, 0, 0, [0, 0, 0]
        pid = context.partitionId() if context else 0
        powers = [np.ones(1, dtype=np.int64) for _ in PRIMES]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            digest = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u8").reshape(n, 4)
            begins = np.concatenate(([ids[0] != conv], ids[1:] != ids[:-1]))
            index = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, index, 0))
            first = ~np.logical_or.accumulate(begins)  # goes on with the conversation of the batch before
            places = index - start + 1 + np.where(first, place, 0)

            def within(values, before):
                total = np.cumsum(values)
                return total - np.where(start > 0, total[start - 1], 0) + np.where(first, before, 0)

            bytes_so_far = within(size, cum)
            columns, terms = [], []
            for k, p in enumerate(PRIMES):
                while len(powers[k]) <= n:
                    more = powers[k] * pow(base[k], len(powers[k]), p) % p
                    powers[k] = np.concatenate((powers[k], more))
                power = powers[k][index - start + 1]
                power = np.where(first, power * pow(base[k], place, p) % p, power)
                term = (digest[:, k] % np.uint64(p)).astype(np.int64) * power % p
                terms.append(term)
                columns.append(within(term, sums[k]) % p)
            conv, place, cum, sums = ids[-1], int(places[-1]), int(bytes_so_far[-1]), [int(c[-1]) for c in columns]
            out = [np.full(n, pid, dtype=np.int32), ids, places, size, bytes_so_far, *columns, *terms, *digest.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], names=["pid", "conv_id", "place", "bytes", "cum", *_SUMS, *_TERMS, *_DIGEST])

    return run


def _carried(scanned: DataFrame, base: list[int]) -> DataFrame:
    """``scanned`` with places and sums over partition borders; one row for each partition goes through the driver."""
    last = F.max_by(F.struct("place", "cum", *_SUMS), F.struct("conv_id", "place")).alias("last")
    ends = scanned.groupBy("pid").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z"), last).orderBy("pid").collect()
    rows, conv, place, cum, sums = [], None, 0, 0, [0, 0, 0]
    for e in ends:
        own = [e.last[c] for c in _SUMS]
        goes_on = e.a == conv
        if goes_on:
            power = [pow(b, place, p) for b, p in zip(base, PRIMES)]
            rows.append((e.pid, e.a, place, cum, *sums, *power))
        if goes_on and e.z == e.a:
            sums = [(s + w * x) % p for s, w, x, p in zip(sums, power, own, PRIMES)]
            place, cum = place + e.last.place, cum + e.last.cum
        else:
            conv, place, cum, sums = e.z, e.last.place, e.last.cum, own
    if not rows:
        return scanned.drop("pid")
    names = ["b_place", "b_cum", "b0", "b1", "b2", "w0", "w1", "w2"]
    borders = scanned.sparkSession.createDataFrame(rows, "pid int, conv_id long, " + ", ".join(f"{c} long" for c in names))
    moved = scanned.join(F.broadcast(borders), ["pid", "conv_id"], "left").na.fill({c: 1 if c[0] == "w" else 0 for c in names})
    changed = {"place": F.col("place") + F.col("b_place"), "cum": F.col("cum") + F.col("b_cum")}
    for k, p in enumerate(PRIMES):
        changed[f"s{k}"] = (F.col(f"b{k}") + F.col(f"w{k}") * F.col(f"s{k}")) % p
        changed[f"t{k}"] = F.col(f"w{k}") * F.col(f"t{k}") % p
    return moved.withColumns(changed).drop("pid", *names)


def stored_turns(conversations: DataFrame, base: list[int]) -> DataFrame:
    """(conv_id, place from 1, bytes, cum, sums, terms, digest) for each turn, without its text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"), digest.alias("digest"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "bytes", "digest")
    return _carried(materialize(dealt.mapInArrow(_scan(base), _SCANNED), "scanned-turns"), base)


def _packed(sums: list[Column]) -> list[Column]:
    return [F.shiftleft(sums[0], 31).bitwiseOR(sums[1]).alias("fa"), sums[2].alias("fb")]


def _members(turns: DataFrame, base: list[int], head_of=head_of, head_turns=head_turns) -> tuple[DataFrame, DataFrame]:
    """One row for each prefix of each rebuilt conversation, and one for each of these with its length and bytes."""
    h = head_turns(F.col("conv_id")).alias("h")
    at_head = [F.coalesce(F.max(F.when(F.col("place") == F.col("h"), F.col(c))), F.lit(0)).alias(f"{c}_h") for c in ("cum", *_SUMS)]
    own = turns.withColumn("h", h).groupBy("conv_id", "h").agg(F.max("place").alias("n"), F.max("cum").alias("own_bytes"), *at_head)
    own = materialize(own.withColumn("head", head_of(F.col("conv_id"))), "own-turns")
    heads = turns.where((F.col("place") <= MOST_HEAD) & (F.col("conv_id") == head_of(F.col("conv_id")))).withColumnRenamed("conv_id", "head")
    heads = materialize(heads, "head-turns")
    used = own.select("conv_id", "h", "head").join(heads, "head").where("place <= h")
    used = used.groupBy("conv_id").agg(F.max("place").alias("k"), F.max(F.struct("place", F.col("cum").alias("cum_k"), *(F.col(c).alias(f"{c}_k") for c in _SUMS))).alias("top"))
    whole = own.join(used.select("conv_id", "k", "top.*").drop("place"), "conv_id", "left").na.fill(0, ["k", "cum_k", *(f"{c}_k" for c in _SUMS)])
    later = F.col("n") > F.col("h")
    whole = whole.withColumns({"len": F.col("k") + F.when(later, F.col("n") - F.col("h")).otherwise(0), "total": F.col("cum_k") + F.when(later, F.col("own_bytes") - F.col("cum_h")).otherwise(0)})
    whole = materialize(whole, "rebuilt")

    def prefixes(rows: DataFrame, depth: Column, sums: list[Column], before: list[Column], cum: Column) -> DataFrame:
        parents = [c.alias(f"p{c_}") for c, c_ in zip(_packed(before), "ab")]
        return rows.select("conv_id", depth.alias("depth"), *_packed(sums), *parents, (cum - F.col("bytes")).alias("before"), (depth == F.col("len")).alias("ends"), *_DIGEST)

    from_head = whole.select("conv_id", "h", "head", "len").join(heads, "head").where("place <= h")
    sums = [F.col(c) for c in _SUMS]
    from_head = prefixes(from_head, F.col("place"), sums, [F.pmod(s - F.col(t), F.lit(p)) for s, t, p in zip(sums, _TERMS, PRIMES)], F.col("cum"))
    # a turn of its own moves from place to place + k - h, so its stretch is multiplied by base^(k - h)
    moved = turns.where(F.col("place") > head_turns(F.col("conv_id"))).join(whole, "conv_id")
    sums, before = [], []
    for k, p in enumerate(PRIMES):
        powers = F.array(*[F.lit(pow(base[k], -j, p)) for j in range(MOST_HEAD + 1)])
        power = F.element_at(powers, (F.col("h") - F.col("k") + 1).cast("int"))
        stretch = F.pmod(F.col(f"s{k}") - F.col(f"s{k}_h"), F.lit(p))
        sums.append((F.col(f"s{k}_k") + power * stretch) % p)
        before.append((F.col(f"s{k}_k") + power * F.pmod(stretch - F.col(f"t{k}"), F.lit(p))) % p)
    from_own = prefixes(moved, F.col("place") + F.col("k") - F.col("h"), sums, before, F.col("cum_k") + F.col("cum") - F.col("cum_h"))
    zero = F.lit(0).cast("long")
    roots = whole.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in ("fa", "fb", "pa", "pb", "before")), (F.col("len") == 0).alias("ends"), *(zero.alias(c) for c in _DIGEST))
    members = materialize(from_head.unionByName(from_own).unionByName(roots), "prefixes")
    whole = materialize(whole.select("conv_id", "len", "total"), "lengths")
    discard(own, heads)
    return members, whole


def _listed(batches):
    """The conv_ids of each node, in pieces of at most a batch."""
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
        starts = np.concatenate(([0], cuts))
        ids = batch.column(3).cast(pa.string()).to_pylist()
        pieces = [",".join(ids[a:b]) for a, b in zip(starts.tolist(), [*cuts.tolist(), len(ids)])]
        yield pa.RecordBatch.from_arrays([pa.array(c[starts]) for c in columns] + [pa.array(pieces)], names=[*KEY, "least", "piece"])


def _hashed(batches):
    """SHA-256 of each node's pieces in order; rows are sorted by node and first conv_id."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if key == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = key, hashlib.sha256(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=[*KEY, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], names=[*KEY, "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of each node at which conversations end."""
    rows = members.where("ends").select(*KEY, "conv_id")
    pieces = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_listed, "depth long, fa long, fb long, least long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_hashed, "depth long, fa long, fb long, ends_sha256 string")


def _groups(members: DataFrame) -> DataFrame:
    """One row for each group (depth, fingerprint) of prefixes; ``same`` says that all their last turns are equal."""
    same = F.lit(True)
    for d in _DIGEST:
        same = same & (F.min(d) == F.max(d))
    return members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.count_if("ends").alias("n_ends"), F.max("before").alias("before"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), same.alias("same")
    )


def nodes(conversations: DataFrame, head_of=head_of, head_turns=head_turns, attempts: int = 8) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations; see the contract of the query."""
    for seed in range(attempts):
        base = bases(seed)
        turns = stored_turns(conversations, base)
        members, whole = _members(turns, base, head_of, head_turns)
        groups = materialize(_groups(members), "prefix-groups")
        if groups.where("NOT same").isEmpty():
            break
        discard(members, whole, groups)
    else:
        raise RuntimeError("no bases tell all prefixes apart")
    top = F.min(F.struct("depth", "pa", "pb", "before")).alias("top")
    owned = materialize(groups.groupBy("conv_id").agg(top, F.bool_or(F.col("n") == F.col("n_ends")).alias("leaf")).select("conv_id", "leaf", "top.*"), "owned")
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent"))
    owned = owned.join(above, ["depth", "pa", "pb"], "left").select("conv_id", "leaf", F.col("depth").alias("first"), F.col("before").alias("until"), "parent")
    owned = whole.join(owned, "conv_id", "left")
    owned = owned.select("conv_id", "len", F.coalesce("leaf", F.lit(False)).alias("leaf"), F.coalesce("first", F.col("len") + 1).alias("first"), F.coalesce("until", "total").alias("until"), "parent")
    owned = materialize(owned, "owners")
    discard(whole, groups)
    parent = F.when((F.col("depth") > 0) & (F.col("first") <= F.col("depth")), F.when(F.col("first") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")))
    found = members.join(owned, "conv_id").groupBy(*KEY)
    found = found.agg(
        F.min("conv_id").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("first") <= F.col("depth") + 1) & (F.col("depth") + 1 <= F.col("len"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("until") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    ends = end_digests(members)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return found.join(ends, list(KEY), "left").select(*names, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
