"""Document fingerprints by closed syncmers, by DataFrame functions alone.

Symbols are words, and each character of scripts that have no spaces, in texts of any length (white space alone: its characters). A run of K symbols is an anchor if the
smallest hash of its runs of S symbols is the first or the last. The choice depends on nothing but the run itself, so texts
that share a passage share its anchors wherever it stands. An anchor is kept with its place, the number of its first symbol; the
fingerprint is the hashes of the distinct anchors in order of place, eight hexadecimal digits each. Two texts are matched by position,
too: of the anchors that both have (each at its first place), most lie as far apart in the two where a passage was moved as a whole, so
the distance that most agree on is its shift. Texts of under FEW symbols also have the hashes of their symbols, and of all
of them together: from 9 symbols on a text has an anchor, so near texts on either side of FEW share anchors.

The document after each is found without a global sort: ids are cut at quantiles into buckets, the first rows of
each bucket also go to the one before, and a window over each bucket looks one row ahead. An id that holds more than one row in
HOT (null may) is cut evenly by its texts' hashes too.

Nulls: a null text is empty; null ids come first and are each other's next like repeated ids, which are ordered by their texts'
hashes; rows that repeat id and text stay together. Two texts without symbols have likeness 1, and a text with none to one with
some 0; without a shared anchor none are aligned and the shift is null; of distances that as many agree on, the least counts. An only row is its own next. Texts of any length are fingerprinted whole. Columns other than doc_id and text aren't
read, so extra ones of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_columns
from .secrets import let

K, S = 6, 2
#: Symbols under which a text has hardly an anchor.
FEW = 16
UNSPACED = r"฀-໿က-႟ក-៿⺀-鿿豈-﫿\x{20000}-\x{3FFFF}"
#: Rows of a bucket, and the most buckets, whose bounds are in the plan (a megabyte) like those of any range partitioning. So buckets grow
#: from 131 million rows on: 20 thousand million rows are 300,000 to a bucket. Their window spills and needs no more memory for that.
PER_BUCKET, MOST_BUCKETS = 2000, 1 << 16
#: One row in so many makes an id hot. There are no more such ids than this.
HOT = 256
_LEAST = -(2**63)


def symbols(text: Column) -> Column:
    chars = F.regexp_extract_all(text, F.lit(rf"[{UNSPACED}]|[^\s{UNSPACED}]+"), F.lit(0))
    words = F.when(text.rlike(f"[{UNSPACED}]"), chars).otherwise(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(text.rlike(r"\S"), words).otherwise(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))


def packed(text: Column, k: int = K, s: int = S) -> Column:
    """array<bigint> of the anchors in order of place, repeated ones too: the hash (31 bits) above the place (32 bits); empty for a text
    without symbols."""
    fold = lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    span = k - s  # from the first to the last inner run

    def inner(h: Column) -> Column:
        out = h
        for i in range(1, s):
            out = F.zip_with(out, F.slice(h, F.lit(1 + i), F.greatest(F.size(h) - i, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        return F.slice(out, F.lit(1), F.greatest(F.size(h) - (s - 1), F.lit(0)))

    def chosen(r: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(r) - 1 - span)
        edge = lambda i: let(F.array_min(F.slice(r, i + 1, F.lit(span + 1))), lambda m: (F.get(r, i) == m) | (F.get(r, i + span) == m))
        run = lambda i: fold(F.xxhash64(*[F.get(r, i + j) for j in range(0, span + 1, s)], *([F.get(r, i + span)] if span % s else [])))
        return F.transform(F.filter(at, edge), lambda i: pack(run(i), i))

    pack = lambda h, i: F.shiftleft(h.cast("long"), 32).bitwiseOR(i.cast("long"))
    none = F.expr("cast(array() as array<bigint>)")
    whole = lambda h: F.when(F.size(h) == 0, none).otherwise(F.concat(F.transform(h, lambda v, i: pack(fold(v), i)), F.array(pack(fold(F.xxhash64(h)), F.lit(0)))))
    found = lambda h: F.when(F.size(h) < k, none).otherwise(let(inner(h), chosen))
    return let(F.transform(symbols(text), lambda w: F.xxhash64(w)), lambda h: let(found(h), lambda a: F.when(F.size(h) >= FEW, a).otherwise(F.concat(a, whole(h)))))


def hashes(a: Column) -> Column:
    """array<int> of the distinct hashes of packed anchors, in order of place."""
    return F.array_distinct(F.transform(a, lambda v: F.shiftright(v, 32).cast("int")))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<int> of the distinct anchors' hashes (31 bits) in order of place; empty for a text without symbols."""
    return hashes(packed(text, k, s))


def aligned(a: Column, b: Column) -> Column:
    """struct<n, shift> of packed anchors a and b: the most that agree on how much later they stand in b, and how much that is. Both are
    sorted together, so that an anchor's first place in a comes right before its first in b: time is that of a sort."""
    place, side = F.lit(0x7FFFFFFF).cast("long"), F.lit(0x80000000)
    of = lambda v: v.bitwiseAND(place)
    both = F.sort_array(F.concat(F.transform(a, lambda v: v.bitwiseXOR(place)), F.transform(b, lambda v: v.bitwiseOR(side))))

    def shifts(s: Column) -> Column:
        def met(i: Column) -> Column:
            low, high = F.get(s, i - 1), F.get(s, i)
            # a's side is 0 and b's 1, so hash and side together differ by one where a's last row meets b's first
            return F.when((F.shiftright(low, 31) + 1 == F.shiftright(high, 31)) & (F.shiftright(low, 32) == F.shiftright(high, 32)), (of(high) - (place - of(low))).cast("int"))

        return F.when(F.size(s) > 1, F.sort_array(F.filter(F.transform(F.sequence(F.lit(1), F.size(s) - 1), met), lambda d: d.isNotNull())))

    last = F.lit(None).cast("int")
    most = F.struct(last.alias("d"), F.lit(0).alias("run"), F.lit(0).alias("n"), last.alias("shift"))

    def longer(m: Column, d: Column) -> Column:
        run = F.when(m["d"] == d, m["run"] + 1).otherwise(F.lit(1))
        return F.struct(d.alias("d"), run.alias("run"), F.greatest(m["n"], run).alias("n"), F.when(run > m["n"], d).otherwise(m["shift"]).alias("shift"))

    return let(F.coalesce(let(both, shifts), F.expr("cast(array() as array<int>)")), lambda d: F.aggregate(d, most, longer, lambda m: F.struct(m["n"].alias("n"), m["shift"].alias("shift"))))


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors among all of both, 0 to 1."""
    shared = lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n))
    return let(F.size(F.array_intersect(a, b)).cast("double"), shared)


def printed(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def fingerprints(df: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, fingerprint, anchors, packed) of every row: the distinct hashes, and all with their places, for `aligned`."""
    own = with_columns(df, doc_id="long", text="string").select("doc_id", packed(F.coalesce("text", F.lit("")), k, s).alias("packed"))
    own = own.withColumn("anchors", hashes(F.col("packed")))
    return own.select("doc_id", printed(F.col("anchors")).alias("fingerprint"), "anchors", "packed")


def _longs(values: list[int]) -> Column:
    """An array that is one literal of the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """Index of the last bound that is at most (key, tie), looked up in two steps."""
    step = max(1, round(len(bounds) ** 0.5))
    if any(t != _LEAST for _, t in bounds):
        own = F.arrays_zip(_longs([k for k, _ in bounds]).alias("k"), _longs([t for _, t in bounds]).alias("t"))
        upto = lambda b: (b["k"] < key) | ((b["k"] == key) & (b["t"] <= tie))
        firsts = F.arrays_zip(_longs([k for k, _ in bounds[::step]]).alias("k"), _longs([t for _, t in bounds[::step]]).alias("t"))
    else:
        own, firsts = _longs([k for k, _ in bounds]), _longs([k for k, _ in bounds[::step]])
        upto = lambda b: b <= key
    part = lambda i: F.slice(own, (i - 1) * step + 1, F.lit(step))
    return let(F.greatest(F.size(F.filter(firsts, upto)), F.lit(1)), lambda i: (i - 1) * step + F.size(F.filter(part(i), upto)) - 1)


def _bounds(ids: DataFrame, per_bucket: int, hot: int) -> list[tuple[int, int]]:
    """ids (key, tie) -> the least (key, tie) of each bucket."""
    n, least = ids.agg(F.count("*"), F.min("key")).first()  # exact, as no quantile may be under it
    many = min(MOST_BUCKETS, max(1, (n or 0) // per_bucket))
    if many < 2:
        return [(least, _LEAST)] if n else []
    close = lambda k: min(20 * k, 4 * MOST_BUCKETS)
    cuts = [max(least, c) for c in (least, *ids.agg(F.percentile_approx("key", [i / many for i in range(1, many)], close(many))).first()[0])]
    times = Counter(cuts)
    wide = [k for k, m in times.items() if m > max(1, many // hot)]
    bounds = sorted({(k, _LEAST) for k in times} | {(k, _LEAST + i * 2**64 // times[k]) for k in wide for i in range(1, times[k])})
    if not wide and max(map(abs, times)) < 2**53:  # quantiles are taken as doubles; these are ids that occur
        return bounds
    own = _bucket(F.col("key"), F.col("tie"), bounds)
    firsts = ids.where(F.col("key") >= least).groupBy(own.alias("b")).agg(F.min(F.struct("key", "tie")).alias("f")).collect()  # a row for each bucket
    return sorted({(r.f.key, r.f.tie) for r in firsts})


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", per_bucket: int = PER_BUCKET, hot: int = HOT) -> DataFrame:
    """Adds next_<column> of the row with the next id (among equal ids, the next hash of the text), the first row's after the last."""
    key = F.coalesce(F.col(id_col), F.lit(_LEAST))
    tie = F.xxhash64("text") if "text" in df.columns else F.xxhash64(*columns)
    bounds = _bounds(df.select(key.alias("key"), tie.alias("tie")), per_bucket, hot)
    if not bounds:
        return df.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"next_{c}") for c in columns])
    keyed = df.withColumns({"_key": key, "_tie": tie}).withColumn("_own", _bucket(F.col("_key"), F.col("_tie"), bounds).cast("int"))
    bound = lambda i: F.get(_longs([b[i] for b in bounds]), F.col("_own"))
    is_first = F.col("_key") == bound(0)
    if any(t != _LEAST for _, t in bounds):
        is_first &= F.col("_tie") == bound(1)
    before = F.when(F.col("_own") > 0, F.col("_own") - 1).otherwise(F.lit(len(bounds) - 1))
    places = F.when(is_first, F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("g")), F.struct(before.alias("b"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("g"))))
    dealt = keyed.select(*df.columns, "_key", "_tie", F.explode(places).alias("_p")).select(*df.columns, "_key", "_tie", F.col("_p.b").alias("_b"), F.col("_p.g").alias("_g"))
    w = Window.partitionBy("_b").orderBy("_g", "_key", "_tie")
    seen = dealt.select(*df.columns, "_g", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return seen.where("_g = 0").drop("_g")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_anchors, the distinct anchors; edited_aligned and edited_shift, those that the edited text has along
    one distance and that distance in symbols; next_aligned and next_shift, the same of the next document."""
    own = with_columns(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own.withColumn("packed", packed(F.col("text"))), ["text", "packed"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = both.select("doc_id", n.cast("long").alias("n_chars"), "packed", "next_packed", F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter)).alias("edited"))
    edited = edited.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_packed": packed(F.col("edited"))}).drop("edited")
    edited = edited.withColumns({f"{c}anchors": hashes(F.col(f"{c}packed")) for c in ("", "next_", "edited_")} | {f"{c}_al": aligned(F.col("packed"), F.col(f"{c}_packed")) for c in ("next", "edited")})
    a, e = F.col("anchors"), F.col("edited_anchors")
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", printed(a).alias("fingerprint"), printed(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"), likeness(a, F.col("next_anchors")).alias("near_next"), F.size(a).alias("n_anchors"),
        *[F.col(f"{c}_al.{v}").alias(f"{c}_{o}") for c in ("edited", "next") for v, o in (("n", "aligned"), ("shift", "shift"))],
    )
