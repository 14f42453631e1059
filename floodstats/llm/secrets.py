"""Secret scans with corpus-wide ownership frequency, by DataFrame functions alone.

Three base kinds are found by their patterns. Besides, any run of 16 or more token characters that has a letter and a digit
and lies outside the base spans is a candidate. All values are hashed, and each hash is counted over distinct owners and distinct
repositories (an owner's; see `repository`) in the whole corpus: one seen with more than `max_owners` owners or in more than `max_repositories`
repositories is a widely copied example, any other is owner-specific and looks live. Live candidates are added to the spans as
kind `live`; base spans always stay.

Counting takes distinct (hash, owner, repository) and then sums by (hash, owner) before the shuffle, so a value that a third of all rows
hold meets as a few rows per task. The counts are written before the way back, so that this is a join of two plain exchanges, whose hot hash adaptive
execution splits; it carries no texts.

Nulls: a null text is empty, a null owner or repository counts as the name ''. Rows with a null id are kept. Repeated rows
each get their spans, and each occurrence of a value in a text is a span of its own. Documents without findings have spans '' and
the hash of ''; an empty table gives an empty result. Texts are searched whole, whatever their length. Positions are code points;
spans that begin together are ordered by kind. Columns other than those named aren't read, so extra ones of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, stash, with_columns

# Fixed values of the contract: the patterns of the base kinds, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a match is the rest of its run, so a shorter one hides none
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ADDRESS = r"https?://[^\x20\x09-\x0D/?#]+(?:/[^\x20\x09-\x0D/?#]+)?"
#: Stands for a masked code point; a text's own are read as blanks. Matches that are summed up together.
MASK, CHUNK = "\ue000", 64
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
REPLACEMENT = "<secret>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once; a lambda would otherwise compute it for each element."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """array<struct<start, end, kind, value>> of leftmost non-overlapping matches: lengths of what split() leaves between them, summed
    up by chunks, so that a text with very many takes no more than in proportion."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,value:string>>)")

    def spans(all_: Column, values: Column, between: Column) -> Column:
        places = lambda c: F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.size(all_)) - 1)
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        long = lambda c: F.aggregate(places(c), F.lit(0), lambda n, i: n + F.length(between[i]) + F.length(all_[i]))
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(chunks, begin, lambda acc, c: F.struct((acc["at"] + long(c)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(between[i])
            e = s + F.length(all_[i])
            one = F.struct(s.alias("start"), e.alias("end"), F.lit(kind).alias("kind"), values[i].alias("value"))
            return F.struct(e.alias("at"), F.array_append(acc["out"], one).alias("out"))

        own = lambda at: F.transform(chunks, lambda c: F.aggregate(places(c), F.struct(at[c].alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return let(starts, lambda at: F.flatten(own(at)))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        use = lambda m: let(F.struct(part.alias("v"), F.split(text, pattern, -1).alias("b")), lambda x: spans(m, x["v"], x["b"]))
    else:
        use = lambda m: let(F.split(text, pattern, -1), lambda b: spans(m, m, b))
    return let(whole, lambda m: F.when(F.size(m) > 0, use(m)).otherwise(none))


def _masked(text: Column) -> Column:
    """text with MASK in place of each code point of its assignments, and blanks for its own."""
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    long = lambda x, i: F.length(x["v"][i]) >= 8
    part = lambda x, i: F.concat(F.translate(x["b"][i], MASK, " "), F.when(long(x, i), F.repeat(F.lit(MASK), F.length(x["m"][i]))).otherwise(x["m"][i]))
    whole = lambda x: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: part(x, i)), ""), F.translate(F.element_at(x["b"], -1), MASK, " "))
    return let(F.struct(every(ASSIGN, 0).alias("m"), every(ASSIGN, 2).alias("v"), F.split(text, ASSIGN, -1).alias("b")), whole)


def findings(text: Column) -> Column:
    """Base spans and candidates, by start and then kind. Access and hex spans are runs that CANDIDATE finds too, so texts without
    any are not searched for them, and a candidate is outside of them if its run holds none; it is outside of the assignments if
    its run doesn't meet them, so these are masked first."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,value:string>>)")
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= 8)
    own = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.contains(MASK) & ~v.rlike(f"{ACCESS}|{HEX}")
    seen = lambda a: F.when(F.size(a) > 0, _masked(text)).otherwise(F.translate(text, MASK, " "))
    candidates = lambda a: F.filter(let(seen(a), lambda x: _matches(x, CANDIDATE.replace("]", f"{MASK}]"), 3, 0)), lambda m: own(m["value"]))
    every = lambda a: F.array_sort(F.concat(a, _matches(text, ACCESS, 1, 0), _matches(text, HEX, 2, 0), candidates(a)))
    return let(assign, lambda a: F.when(text.rlike(CANDIDATE), every(a)).otherwise(F.when(F.size(a) > 0, a).otherwise(none)))


def repository(text: Column, doc_id: Column) -> Column:
    """What a document is a part of: the host of the first address in it with the first part of its path, else the document itself."""
    return F.when(text.contains("://"), F.coalesce(F.nullif(F.regexp_extract(text, ADDRESS, 0), F.lit("")), F.concat(F.lit("#"), F.coalesce(doc_id.cast("string"), F.lit(""))))).otherwise(F.concat(F.lit("#"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def scan(df: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """df (doc_id, text, owner, repository) -> (doc_id, text_hash, base, added, n_live, n_copied, ownership): spans as arrays of structs.

    n_live and n_copied count the values, base ones too, by what their ownership says of them; ownership has the distinct owners
    and repositories of each.
    """
    text = F.coalesce("text", F.lit(""))
    rows = df.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), findings(text).alias("found"))
    hashed = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), F.sha2(m["value"], 256).alias("hash")))
    rows = stash(rows.withColumn("found", hashed).withColumn("row", F.monotonically_increasing_id()))
    each = rows.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("m")).select("row", "owner", "repository", "m.*")
    places = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owned = stash(places.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    told = each.select("row", "hash", "start", "end", "kind").join(owned, "hash").withColumn("live", live)
    per_row = told.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "end", "kind"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "owners", "repositories"))).alias("ownership"),
    )
    base = F.filter(F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))), lambda m: m["kind"] < 3)
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    unowned = F.expr("cast(array() as array<struct<start:int,kind:int,owners:bigint,repositories:bigint>>)")
    out = rows.join(per_row, "row", "left")
    return out.select(
        "doc_id", "text_hash", base.alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("ownership", unowned).alias("ownership")
    )


def _of_documents(docs: DataFrame) -> DataFrame:
    own = with_columns(docs, doc_id="long", text="string", source="string")
    return own.select("doc_id", "text", F.col("source").alias("owner"), repository(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("repository"))


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))
    text = lambda m: F.concat_ws(":", let(m["kind"], lambda k: F.element_at(name, k + 1)), m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(ordered, text), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """The contract's columns; the owner is the source. ownership: start:owners:repositories of
    every value, by start and kind."""
    s = scan(_of_documents(docs))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    owned = F.array_join(F.transform("ownership", lambda m: F.concat_ws(":", m["start"].cast("string"), m["owners"].cast("string"), m["repositories"].cast("string"))), ",")
    return s.select("doc_id", count(0), count(1), count(2), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), "n_live", "n_copied", owned.alias("ownership"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with base and live spans replaced, and n_chars set anew where something was. Only rows with findings are joined."""
    p, text = free_prefix(docs), F.coalesce("text", F.lit(""))
    hit, at, out = f"{p}hit", f"{p}at", f"{p}out"
    marked = docs.withColumn(hit, text.rlike(CANDIDATE) | text.rlike(ASSIGN))  # every access and hex span is in a candidate's run
    clean, found = marked.where(~F.col(hit)).drop(hit), marked.where(hit).drop(hit)
    s = scan(_of_documents(docs)).select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"), F.array_sort(F.concat("base", "added")).alias(f"{p}spans"))
    s = s.where(F.size(f"{p}spans") > 0).dropDuplicates([f"{p}id", f"{p}hash"])
    both = found.withColumn(f"{p}text_hash", F.xxhash64(text)).join(s, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}text_hash") == F.col(f"{p}hash")), "left")

    def step(acc: Column, m: Column) -> Column:
        ahead = F.concat(acc[out], F.substring("text", acc[at] + 1, F.greatest(m["start"] - acc[at], F.lit(0))), F.lit(REPLACEMENT))
        longer = F.struct(F.greatest(m["end"], acc[at]).alias(at), acc[out].alias(out))
        return F.when(m["start"] >= acc[at], F.struct(m["end"].alias(at), ahead.alias(out))).otherwise(longer)

    done = F.aggregate(f"{p}spans", F.struct(F.lit(0).alias(at), F.lit("").alias(out)), step, lambda acc: F.concat(acc[out], F.col("text").substr(acc[at] + 1, F.length("text"))))
    both = both.withColumn(f"{p}done", F.when(F.col(f"{p}spans").isNotNull(), done))
    new = {"text": F.coalesce(f"{p}done", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{p}done").isNotNull(), F.length(f"{p}done").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    kept = [new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return clean.unionByName(both.select(*kept))
