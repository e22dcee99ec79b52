"""Order MinHash fingerprints with built-in functions only.

A text is cut into short units (runs of up to four non-space characters, so a word gives one or
more). Where more than 16 non-space characters are ahead without a space, units overlap, one from each
character, so an insertion into a text without spaces changes only the units around it and those of the
last 16 characters. Every run of `k` units is a k-mer; a k-mer that
comes again gets the next occurrence number, so repeats count. One hash of (k-mer, occurrence) deals
the k-mers into 64 slots and orders them there; the two smallest of a slot, put back in text order,
are hashed together (a slot with one k-mer takes its second from the next slot). Equal slots need the same k-mers in the same order, so a fingerprint follows
edit distance rather than set overlap. Everything of one text happens in array expressions of its
own row: no rows are exploded and nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 4
_POS_BITS = 26  # units of a text that positions can hold: 67 million
_POS = (1 << _POS_BITS) - 1
_SLOT_SHIFT = 58  # 64 slots


def units(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?=(\S{1,4}))(?:\S(?=\S{16})|\S{1,4})"), F.lit(1)), lambda x: F.xxhash64(x))


def _hashed_kmers(u: Column, k: int) -> Column:
    """38 bits of each k-mer's hash over 26 bits of its position; u: hashes of the units. Under k units: one k-mer of all."""
    whole = F.array(F.xxhash64(F.array_join(F.transform(u, lambda x: x.cast("string")), " ")).bitwiseAND(~_POS))
    runs = F.transform(
        F.slice(u, F.lit(1), F.greatest(F.size(u) - (k - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(u, i + j) for j in range(1, k)]).bitwiseAND(~_POS).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(u) >= k, runs).when(F.size(u) > 0, whole).otherwise(F.array().cast("array<long>"))


def _same_kmer(a: Column, b: Column) -> Column:
    return F.shiftright(a, _POS_BITS) == F.shiftright(b, _POS_BITS)


def _repeats(ordered: Column) -> Column:
    """Indexes in the sorted k-mers whose k-mer is also the one before."""
    return F.filter(F.sequence(F.lit(1), F.size(ordered) - 1), lambda i: _same_kmer(F.get(ordered, i), F.get(ordered, i - 1)))


def _occurrences(rep: Column) -> Column:
    """Occurrence number of each repeat: its place in its run of neighbouring indexes.

    Where a run starts in `rep` is a running maximum, found by doubling steps.
    """
    first = F.transform(rep, lambda x, j: F.when((j > 0) & (F.get(rep, j - 1) == x - 1), F.lit(0)).otherwise(j))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(rep).cast("double"))).cast("int")), lambda s: F.pow(F.lit(2.0), s).cast("int"))
    starts = F.aggregate(steps, first, lambda acc, step: F.transform(acc, lambda x, j: F.greatest(x, F.coalesce(F.get(acc, F.when(j >= step, j - step)), F.lit(0)))))
    return F.transform(starts, lambda x, j: j - x + 1)


def _with_repeats(ordered: Column, firsts: Column, rep: Column, occurrences: Column) -> Column:
    """Every (k-mer, occurrence) in one long, ascending: slot, priority and position. Repeats are hashed anew."""

    def again(i: Column, occurrence: Column) -> Column:
        kmer = F.get(ordered, i)
        return F.coalesce(F.xxhash64(F.shiftright(kmer, _POS_BITS), occurrence).bitwiseAND(~_POS).bitwiseOR(kmer.bitwiseAND(_POS)), F.lit(0).cast("long"))

    # zip_with takes the occurrences outside its lambda, so that they are worked out once
    return F.when(F.size(rep) > 0, F.sort_array(F.concat(firsts, F.zip_with(rep, occurrences, again)))).otherwise(firsts)


def _slot(x: Column) -> Column:
    return F.shiftright(x, _SLOT_SHIFT)


def _tuples(kept: Column) -> Column:
    """One long per filled slot: the slot over 32 bits of the hash of two k-mers in text order.

    They are the slot's two smallest; a slot with one k-mer takes the smallest of the next filled slot as the
    second (the last slot: of the first one), so that short texts keep their order too.
    """

    def prio(x: Column) -> Column:
        return F.shiftright(x, _POS_BITS)

    def entry(x: Column, i: Column) -> Column:
        other = F.when(F.size(kept) > 1, F.coalesce(F.get(kept, i + 1), F.get(kept, F.lit(0))))
        forward = x.bitwiseAND(_POS) < other.bitwiseAND(_POS)
        pair = F.when(other.isNull(), F.xxhash64(prio(x))).when(forward, F.xxhash64(prio(x), prio(other))).otherwise(F.xxhash64(prio(other), prio(x)))
        first = (i == 0) | (_slot(F.get(kept, i - 1)) != _slot(x))
        return F.when(first, F.shiftleft(_slot(x).bitwiseAND(63), 32).bitwiseOR(pair.bitwiseAND(0xFFFFFFFF)))

    return F.filter(F.transform(kept, entry), lambda x: x.isNotNull())


def with_signature(df: DataFrame, text_col: str, out: str, k: int = K) -> DataFrame:
    """Add array<long> `out`: at most one entry per slot, ascending. Null and white-space texts: empty."""
    u, h, f, r, s, p = (f"__{out}_{x}" for x in "uhfrsp")
    none = F.array().cast("array<int>")
    df = df.withColumn(u, units(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(h, F.sort_array(_hashed_kmers(F.col(u), k))).drop(u)
    df = df.withColumn(f, F.filter(F.col(h), lambda x, i: (i == 0) | ~_same_kmer(x, F.get(F.col(h), i - 1))))
    df = df.withColumn(r, F.when(F.size(f) < F.size(h), _repeats(F.col(h))).otherwise(none))
    df = df.withColumn(s, F.when(F.size(r) > 0, _occurrences(F.col(r))).otherwise(none))
    df = df.withColumn(p, _with_repeats(F.col(h), F.col(f), F.col(r), F.col(s))).drop(h, f, r, s)
    two = F.filter(F.col(p), lambda x, i: (i < 2) | (_slot(F.get(F.col(p), i - 2)) != _slot(x)))
    df = df.withColumn(p, two)
    return df.withColumn(out, _tuples(F.col(p))).drop(p)


def likeness(a: str, b: str) -> Column:
    """Equal slots over slots filled in either; 1 if both are empty."""
    slot = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(F.array_union(slot(F.col(a)), slot(F.col(b))))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def as_text(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.hex(x))), ".")


#: Rows of one range of ids, and ranges on each of two levels at most.
RANGE_ROWS, RANGES = 4_000, 128


def with_next_document(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add next_<column> of the following row by ascending doc_id; the last row's next is the first.

    Ids are cut at quantiles into even ranges, as many as the rows ask for, found on two levels; the first row of
    each range is also sent to the range before, so one shuffle by range answers every row. Null ids come
    first; repeated ids are ordered by the first of `columns`. A range may be larger than a task's memory, as
    its window is sorted on disk and read in order.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.withColumn("__key", key)
    n_rows, lowest = keyed.agg(F.count(F.lit(1)), F.min("__key")).first()
    if not n_rows:
        return keyed.select(*docs.columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    wanted = min(RANGES**2, max(64, -(-n_rows // range_rows)))
    cuts = keyed.agg(F.percentile_approx("__key", [i / wanted for i in range(1, wanted)], 100_000)).first()[0]
    bounds = sorted({lowest, *cuts})
    n, step = len(bounds), -(-len(bounds) // RANGES)
    longs = lambda values: F.array(*[F.lit(b).cast("long") for b in values])
    upto = lambda values: F.size(F.filter(values, lambda b: b <= F.col("__key")))
    top = upto(longs(bounds[::step])) - 1
    below = F.array(*[longs(bounds[i : i + step]) for i in range(0, n, step)])
    keyed = keyed.withColumn("__own", top * step + upto(F.get(below, top)) - 1)
    before = F.when(F.get(F.get(below, F.expr(f"__own div {step}").cast("int")), F.col("__own") % step) == F.col("__key"), (F.col("__own") + n - 1) % n)
    places = F.array_compact(F.array(F.struct(F.col("__own").alias("b"), F.lit(0).alias("guest")), F.when(before.isNotNull(), F.struct(before.alias("b"), F.lit(1).alias("guest")))))
    sent = keyed.withColumn("__b", F.explode(places)).select("*", "__b.b", "__b.guest").drop("__b", "__own")
    w = Window.partitionBy("b").orderBy("guest", "__key", columns[0])
    led = sent.select(*docs.columns, "guest", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where("guest = 0").drop("guest")


def order_minhash(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars/4) code points replaced by the first as many (or all) of
    the next document. Defined cases: null text is the empty text; an empty or white-space text has an
    empty fingerprint, like only another empty one; a text of fewer than k units is like only its equals; a very long
    text is read whole, within one row; a single document is its own next; of rows that tie in doc_id the one with the
    smaller text comes first; repeated rows come out once each; an empty table gives an empty result; other columns are
    ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = with_signature(base, "text", "sig", k)
    led = with_next_document(base, ["text", "sig"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    led = led.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    led = with_signature(led, "edited", "edited_sig", k)
    return led.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
