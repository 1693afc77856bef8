"""Secret scan with corpus-wide ownership frequency, by built-in functions only.

Fixed patterns give the base spans. Besides them every long mixed token is a candidate. The hashes of all candidates are
aggregated over the corpus by distinct repositories (documents) and owners (sources): what several owners or many
repositories hold is a copied example; what one owner has in a few repositories, and what looks live (random characters,
no name of code, path, stand-in or encoded file), is that owner's secret. Both counts decide: they give every span its class, and only tokens of the class `owned` are added to the base
spans, as spans of kind `owner`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .native import with_spans

# The kinds in their order, with patterns and the least length of what counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "owner"]
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

#: Candidates of the method: runs of this length that mix lower case, upper case and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: What secrets consist of.
CHARACTERS = string.ascii_letters + string.digits + "+/_.=-"
#: Words, in any case, and runs that show a stand-in and no live secret. Runs are so long that random hex hardly holds one.
STAND_IN = r"(?i)example|sample|dummy|changeme|placeholder|redacted|your[_-]|xxxxxx|000000|123456|abcdef"
#: Of two places of a live token at most one pair in so many has equal characters.
SPREAD = 10
#: Longer tokens are encoded data (images, fonts, certificates), not credentials.
LONGEST = 256
#: Words as names of code and paths have them: long ones, and any.
LONG_WORD, ANY_WORD = "[A-Z]?[a-z]{4,}", "[A-Z]?[a-z]{2,}"


def looks_named(value: Column) -> Column:
    """Whether a token reads like a name: half of it are words of five letters or so, or three quarters are words of any length. Of random tokens one in some hundred does."""
    inside = lambda word: F.length(value) - F.length(F.regexp_replace(value, F.lit(word), F.lit("")))
    return (inside(LONG_WORD) * 2 >= F.length(value)) | (inside(ANY_WORD) * 4 >= F.length(value) * 3)


def looks_live(value: Column) -> Column:
    """Whether characters are spread like random ones (by whole numbers), no stand-in is in it, and it is neither a name nor a long piece of encoded data."""
    times = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("long")
    equal = F.aggregate(F.array(*map(F.lit, CHARACTERS)), F.lit(0).cast("long"), lambda total, c: total + times(c) * times(c))
    spread = equal * SPREAD <= F.length(value).cast("long") * F.length(value)
    return spread & ~value.rlike(STAND_IN) & ~looks_named(value) & (F.length(value) <= LONGEST)


def _free(found: DataFrame) -> DataFrame:
    """found less the tokens that overlap a base span of their text: running ends from the left, running starts from the right."""
    of_text = Window.partitionBy("doc_id", "version")
    base = F.col("kind") < 3
    up_to = of_text.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_on = of_text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = found.withColumn("_end", F.max(F.when(base, F.col("end"))).over(up_to)).withColumn("_start", F.min(F.when(base, F.col("start"))).over(from_on))
    clear = (F.coalesce("_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("_start", F.col("end")) >= F.col("end"))
    return over.where(base | clear).drop("_end", "_start")


def secret_scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_owners: int = 1, most_repositories: int = 10) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owner, n_copied, classes) of every row of docs (doc_id, text and the two named columns).

    Spans are kind:start:end in code points, by start and then kind. classes: each span's class, in the order of spans,
    comma-joined: `copied` if more than most_owners owners or more than most_repositories repositories hold its secret,
    else `owned` if it looks live, else `plain`. n_owner: spans that the method adds, which overlap no base span and are
    owned; n_copied: base spans of the class copied.

    Null text is empty: no spans. A null owner or repository counts as one of its own. Rows that repeat a doc_id and a
    text get the same result each, and count once as a repository. Other columns are ignored. An empty table: no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(owner).cast("string").alias("own"), F.col(repository).cast("string").alias("repo"))
    keyed = docs.withColumn("version", F.xxhash64("text"))
    found = with_spans(keyed, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owner": TOKEN}).drop("text")
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 2)
    tagged = lambda kind, spans: F.transform(spans, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (value(x) if kind == "assign" else x["value"]).alias("value")))
    assign = F.filter("assign", lambda x: F.length(value(x)) >= ASSIGN_VALUE)
    access = F.filter("access", lambda x: F.length(x["value"]) >= ACCESS_LENGTH)
    mixed = F.filter("owner", lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    all_kinds = F.concat(tagged("assign", assign), tagged("access", access), tagged("hex", F.col("hex")), tagged("owner", mixed))
    found = found.select("doc_id", "version", "own", "repo", F.explode(all_kinds).alias("x")).select("doc_id", "version", "own", "repo", "x.*")
    judged = found.select("doc_id", "version", "own", "repo", "kind", "start", "end", F.xxhash64("value").alias("hash"), looks_live(F.col("value")).alias("live"))
    found = staged(_free(judged.distinct()))

    # distinct repositories, then owners, of each candidate; each step adds up before it shuffles
    held = found.select("hash", "own", "repo").distinct().groupBy("hash", "own").agg(F.count("*").alias("repos"))
    held = staged(held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))  # so that the join with a widely copied secret's rows can be split
    copied = (F.col("owners") > most_owners) | (F.col("repos") > most_repositories)
    classed = found.join(held, "hash").withColumn("class", F.when(copied, "copied").when(F.col("live"), "owned").otherwise("plain"))
    classed = classed.where((F.col("kind") < 3) | (F.col("class") == "owned"))
    names = F.array(*map(F.lit, KINDS))
    label = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    ordered = F.array_sort(F.collect_set(F.struct("start", "kind", "end", "class")))
    each = classed.groupBy("doc_id", "version").agg(
        ordered.alias("all"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.count_if((F.col("kind") < 3) & (F.col("class") == "copied")).alias("n_copied"),
    )
    each = each.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    joined = keyed.select("doc_id", "version").join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,class:string>>"))
    text = lambda spans: F.array_join(F.transform(spans, label), ",")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id", *(number(f"n_{k}") for k in KINDS[:3]), F.sha2(text(F.filter(every, lambda x: x["kind"] < 3)), 256).alias("base_sha256"), text(every).alias("spans"), number("n_owner"), number("n_copied"),
        F.array_join(F.transform(every, lambda x: x["class"]), ",").alias("classes"),
    )
