"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Spans come from two expressions per pattern: `regexp_extract_all` gives the matches and `split` the pieces between
them, so running sums of their lengths give each match's place in code points. The sums run in windows over the
matches, so a text of very many costs no more for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, numbered

#: The three base patterns, in order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the method beyond these: long runs of key material of which some piece looks drawn at random.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
#: A piece, what stands between separators, must have so many characters and changes between letters and digits, and a
#: break of kind once in so many characters.
PIECE, CHANGES, EVERY = 16, 3, 4
#: The same runs, but none is tried from inside a run, which would take the square of a word's length.
HEX_RUN, TOKEN_RUN = r"(?<![0-9a-f])[0-9a-f]{24,}+", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
KINDS = ("assign", "access", "hex", "owned")


#: Code points of the pieces that a text is cut into for redaction.
CHUNK = 1024


def matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """array<struct<k, g, n, v>> of the matches in order: kind, length of the gap before, length of the match (both in
    code points), and the text of the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), group) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    found = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("n"), value.alias("v")), lambda x: F.struct(F.lit(kind).alias("k"), F.length(x["g"]).alias("g"), F.length(x["n"]).alias("n"), x["v"].alias("v")))
    # most texts hold no match: one search decides, before anything is split
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<k:int,g:int,n:int,v:string>>"))


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_matches(docs: DataFrame, key: str, owner: str, text: str, carry: list[str]) -> DataFrame:
    """One row per document: __row (unique), __repo, __owner, found (the matches of all four patterns)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.concat(matches(t, 0, ASSIGN, 2), matches(t, 1, ACCESS), matches(t, 2, HEX_RUN), matches(t, 3, TOKEN_RUN))
    return docs.select(
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)], F.monotonically_increasing_id().alias("__row"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__repo"), F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("__owner"), found.alias("__found"),
    )


def key_like(value: Column) -> Column:
    """Whether some piece of a token between `/`, `_`, `+` and `-` looks drawn at random: long, with several changes between
    letters and digits, and breaks of kind that are close together: between letters and digits, and from small letters to
    capitals. Words, slugs, dated paths, file names, UUIDs and names in camel case have fewer. Expressions squeeze runs of
    one kind into one character, so that kinds are counted as lengths."""

    def like(p: Column) -> Column:
        kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
        changes = F.length(F.regexp_replace(kinds, "[Aa]+", "a")) - 1
        breaks = F.length(F.replace(kinds, F.lit("Aa"), F.lit("a"))) - 1
        return (F.length(p) >= PIECE) & (changes >= CHANGES) & (breaks * EVERY >= F.length(p))

    return F.exists(F.split(value, "[/_+-]"), like)


def place(scanned: DataFrame) -> DataFrame:
    """One row per span: __row, __repo, __owner, h (hash of the value), x (struct<s, k, e, v>). A span's place is the
    running sum of the lengths before it; too short assignments and tokens that don't look like keys go after that."""
    each = scanned.where(F.size("__found") > 0).select("__row", "__repo", "__owner", F.posexplode("__found").alias("i", "m")).select("__row", "__repo", "__owner", "i", "m.*")
    end = F.sum(F.col("g") + F.col("n")).over(Window.partitionBy("__row", "k").orderBy("i")).cast("int")
    each = each.withColumn("e", end)
    short = (F.col("k") == 0) & (F.length("v") < 6)
    plain = (F.col("k") == 3) & ~key_like(F.col("v"))
    x = F.struct((F.col("e") - F.col("n")).alias("s"), "k", "e", "v")
    return each.where(~short & ~plain).select("__row", "__repo", "__owner", F.xxhash64("v").alias("h"), x.alias("x"))


def ownership(placed: DataFrame) -> DataFrame:
    """Per candidate hash (of a base span's value or of a token): repos and owners it occurs in, each counted once.

    Counting goes by hash, then by hash and owner with a partial sum before each shuffle, so an example copied into a
    third of all documents is a handful of rows when its key meets in one task.
    """
    once = placed.groupBy("h", "__owner", "__repo").agg(F.lit(1).alias("one"))
    per_owner = once.groupBy("h", "__owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("h").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def scan(docs: DataFrame, max_owners: int = 1, max_repos: int = 20, key: str = "doc_id", owner: str = "source", text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of `carry`, base and spans as array<struct<s, k, e, v>> (k: index in KINDS)
    and live (the values that look owner-specific).

    A document counts as a repository, its source as the owner. A value is *live* if at most `max_owners` owners and
    `max_repos` repositories hold it; one that is copied more widely is an example. The base spans are all kept,
    whoever owns them; the method adds an `owned` span for every candidate token that is live and that no base span
    covers. Null text: no span. Null key or owner: one repository or owner of its own. Repeated rows: one result each.
    Empty table: empty result. Columns of docs outside `carry` are not returned, and carried ones may not bear the names
    of the new ones. Work grows in proportion to text and spans, however many spans a text has.
    """
    clash = {"base", "spans", "live"} & set(carry)
    if clash:
        raise ValueError(f"columns {sorted(clash)} can't be carried: the result has its own")
    found = materialize(find_matches(docs, key, owner, text, list(carry)), "secrets")
    placed = materialize(place(found), "placed")
    owners = materialize(ownership(placed).where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("h", F.lit(True).alias("live")), "owners")
    each = placed.select("__row", "h", "x").join(owners, "h", "left").select("__row", "x", F.coalesce("live", F.lit(False)).alias("live"))
    # whether a base span begins before a token's end and ends after its start: the furthest end so far, or the next start
    own, by_start = F.col("x.k") == 3, Window.partitionBy("__row").orderBy("x.s", "x.k")
    reached = F.max(F.when(~own, F.col("x.e"))).over(by_start)
    backward = Window.partitionBy("__row").orderBy(F.desc("x.s"), F.desc("x.k"))  # a frame up to the end would be walked anew for each row
    following = F.min(F.when(~own, F.col("x.s"))).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumns({"reached": reached, "following": following})
    clear = (F.coalesce("reached", F.lit(0)) <= F.col("x.s")) & (F.col("following").isNull() | (F.col("following") >= F.col("x.e")))
    base, added = F.when(~own, F.col("x")), F.when(~own | (F.col("live") & clear), F.col("x"))
    of_row = each.groupBy("__row").agg(F.collect_list(base).alias("base"), F.collect_list(added).alias("spans"), F.array_distinct(F.collect_list(F.when(F.col("live"), F.col("x.v")))).alias("live"))
    both = found.drop("__found", "__repo", "__owner").join(of_row.withColumnRenamed("__row", "r"), F.col("__row") == F.col("r"), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    return both.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("live", F.array().cast("array<string>")).alias("live"))


def holes(found: DataFrame, ident: str, spans: str) -> DataFrame:
    """ident and cuts, array<array<struct<s, e, mark>>>: for each chunk of CHUNK code points up to the last span, what is
    cut out of it, counted from its start, and whether the mark goes there. Spans that touch or overlap are one."""
    each = found.select(ident, F.explode(spans).alias("x")).select(ident, F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    by_start = Window.partitionBy(ident).orderBy("s", "e")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # what is left of a span beyond those before it; it bears the mark unless it begins inside or at the end of one
    each = each.withColumn("before", before).withColumns({"mark": F.col("before").isNull() | (F.col("s") > F.col("before")), "s": F.greatest("s", F.coalesce("before", F.lit(0)))}).where("s < e")
    chunk = lambda c: F.floor(c / F.lit(CHUNK)).cast("int")
    each = each.withColumn("j", F.explode(F.sequence(chunk(F.col("s")), chunk(F.col("e") - 1))))
    start = F.col("j") * CHUNK
    local = F.struct((F.greatest(F.col("s"), start) - start).alias("s"), (F.least(F.col("e"), start + CHUNK) - start).alias("e"), (F.col("mark") & (F.col("s") >= start)).alias("mark"))
    cuts = each.select(ident, "j", local.alias("cut"))
    every = cuts.groupBy(ident).agg(F.max("j").alias("top")).select(ident, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("j"), F.lit(None).cast("struct<s:int,e:int,mark:boolean>").alias("cut"))
    per_chunk = cuts.unionByName(every).groupBy(ident, "j").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    return per_chunk.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("j", "cuts"))).alias("c")).select(ident, F.transform("c", lambda x: x["cuts"]).alias("cuts"))


def redact(text: Column, cuts: Column, mark: str = "[secret]") -> Column:
    """The text without what `holes` says, and with the mark where it says so. The text is cut into chunks once; each is
    then worked on by itself."""

    def clean(chunk: Column, own: Column) -> Column:
        def step(acc, x):
            piece = F.concat(F.substring(chunk, acc["at"] + 1, x["s"] - acc["at"]), F.when(x["mark"], F.lit(mark)).otherwise(F.lit("")))
            return F.struct(x["e"].alias("at"), F.concat(acc["out"], piece).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        done = F.aggregate(own, start, step, lambda acc: F.concat(acc["out"], F.substring(chunk, acc["at"] + 1, F.lit(CHUNK))))
        return F.when(own.isNull() | (F.size(own) == 0), chunk).otherwise(done)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    return F.array_join(F.zip_with(chunks, cuts, clean), "")


def redact_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", **options) -> DataFrame:
    """docs with every secret span of `scan` replaced in the text. Rows and columns stay; texts without a span are
    unchanged, null texts stay null. Rows are matched by an id given before the scan, not by their key. Other columns are
    carried, whatever they are called."""
    renamed, own = numbered(docs)
    rows = materialize(renamed.withColumn("__id", F.monotonically_increasing_id()), "rows")
    spans_of = scan(rows, key=own[key], owner=own[owner], text=own[text], carry=("__id",), **options)
    cuts = holes(spans_of.where(F.size("spans") > 0), "__id", "spans")
    done = rows.join(cuts.hint("merge"), "__id", "left")  # hits grow with the corpus
    clean = F.when(F.col("cuts").isNull(), F.col(own[text])).otherwise(redact(F.col(own[text]), F.col("cuts")))
    return done.withColumn(own[text], clean).select(*own.values()).toDF(*docs.columns)
