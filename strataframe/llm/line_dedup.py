"""Line dedup by a log-template tree, with DataFrame functions alone.

A line's tokens are its words; tokens with a digit are variable and read as
``<*>``. The tree has a fixed depth: a line goes to the leaf of its token count
and its first ``depth`` tokens. In a leaf there are two kinds of template:

* the lines that are equal after masking, if at least ``MIN_CONSTANTS`` of their tokens are constant words (lines with
  fewer, variable fields all but for signs, only if they are wholly equal), and
* generalised templates for the remaining lines, any number of them: the tokens of a line that stand at their place in
  ``min_docs``, 4, 16, ... times ``min_docs`` lines of the leaf, the others being variable fields, so families
  that share a leaf with each other or with prose are told apart by what is frequent in each; and, at each place, the token that half
  of all lines of the leaf have. It has to have ``similarity`` of its tokens constant, or two constant words after
  the first ``depth`` and half of all places without digits. A line belongs to it if ``similarity`` of all
  its tokens, or of the constants after the first ``depth``, are the template's; its variable fields match anything.

A template recurs if its lines stand in enough different texts (equal texts
count once): ``min_docs``, but for equal lines of over 50 words 2, of over 20 words 3, and of fewer than
``min_tokens`` words 100, so short a line being little evidence of a template; without a letter it is none. A word
is a token or, where that gives more, eight bytes of the line, for scripts without spaces. Its lines are dropped everywhere but in the
document with the smallest id that has it, so nothing leaves the corpus
altogether.

Counts go through two steps, (template, text) and then template, so a line that
a third of all documents share is combined before it is exchanged. Texts are
exchanged twice: to read the tokens of lines in shared leaves, and to be rebuilt.
What is found on the way is checkpointed in files by its size, not by the number of shuffle partitions (``common.gathered``).

Cases: null text stays null (n_lines 0); an empty text has one empty line, which is kept; ids rank
null last; repeated rows are rebuilt alike; line ends stay as they are (only
\\n separates lines); other columns of the input are returned unchanged,
whatever their names; an empty table gives an empty result. Lines and texts may
have any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_table, files_for, gathered, join_by_weight, maybe_in, saved, words_of

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 10
MIN_TOKENS = 4
#: Lines of more words than these need 2 and 3 different texts, those under MIN_TOKENS so many.
PASSAGE_TOKENS = 50
LONG_TOKENS = 20
SHORT_DOCS = 100
#: Words that a template with variable fields has at least, whatever their share.
MIN_CONSTANTS = 2
_LAST = 2**63 - 1
ANY = "<*>"


def masked_tokens(line: Column) -> Column:
    """Words of a line, those with a digit masked."""
    return words_of(F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", ANY))


def masked(line: Column) -> Column:
    """The masked words joined by single spaces; most lines are so already and are only looked through."""
    odd = line.rlike(r"[0-9\x09\x0B-\x0D]") | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.array_join(masked_tokens(line), " ")).otherwise(line)


def _is_word(token: Column) -> Column:
    return (token != ANY) & token.rlike(r"\p{L}")


def _needed(weight: Column, min_docs: int, min_tokens: int) -> Column:
    """Different texts that a line of so many words has to stand in: the longer it is, the less is it alike by chance."""
    few = F.when(weight > PASSAGE_TOKENS, min(2, min_docs)).when(weight > LONG_TOKENS, min(3, min_docs))
    return few.when(weight >= min_tokens, min_docs).otherwise(max(SHORT_DOCS, min_docs))


def _matched(members: DataFrame, leaves: DataFrame, lots: int, depth: int, similarity: float, min_docs: int, files: int) -> DataFrame:
    """(doc, body, at, key): lines of members(doc, body, at, leaf, tokens) with each generalised template of their leaf that they belong to.
    leaves(leaf, texts) has the weights of leaves, which sum up to lots or less.

    In a template a variable field is an empty token and ANY a place of digits.
    """
    # Lines are named by the hash of their tokens, which they lose where they are taken apart. Equal texts vote once.
    members = members.withColumn("line", F.xxhash64("tokens"))
    lines = members.groupBy("leaf", "line", "body").agg(F.first("tokens").alias("tokens")).groupBy("leaf", "line")
    lines = gathered(lines.agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")), files)
    places = lines.select("leaf", "line", "texts", F.posexplode("tokens").alias("place", "token"))
    votes = places.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n"))
    # Levels of frequency: tokens that stand at their place in min_docs, 4 min_docs, 16 min_docs ... lines; -1 for fewer.
    level = F.when(F.col("n") >= min_docs, F.floor(F.log(F.col("n") / min_docs + 1e-9) / math.log(4)).cast("int")).otherwise(-1)
    votes = gathered(votes.withColumn("level", level), files)
    best = votes.groupBy("leaf", "place").agg(F.sum("n").alias("all"), F.max(F.struct("n", "token")).alias("top"))
    best = best.select("leaf", "place", F.when(2 * F.col("top.n") >= F.col("all"), F.col("top.token")).otherwise("").alias("token"))
    most = best.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda p: p["token"]).alias("template"))

    # A line's patterns: its tokens of a level or above. Lines of one pattern are a family.
    levelled = places.join(votes.where("level >= 0").select("leaf", "place", "token", "level"), ["leaf", "place", "token"], "left")
    # The only token of a level or the next at a place: where a line has another one there, its family has this one.
    near = votes.where("level >= 0").select("leaf", "place", "token", F.explode(F.array("level", F.col("level") - 1)).alias("level"))
    near = near.groupBy("leaf", "place", "level").agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("token")).where("n = 1 and level >= 0")
    fill = near.groupBy("leaf", "place").agg(F.map_from_entries(F.collect_list(F.struct("level", "token"))).alias("fill"))
    levelled = levelled.withColumn("level", F.coalesce("level", F.lit(-1))).join(fill, ["leaf", "place"], "left")
    levelled = levelled.groupBy("leaf", "line", "texts").agg(F.collect_list(F.struct("place", "token", "level", "fill")).alias("at"))
    in_order = F.array_sort("at", lambda a, b: a["place"] - b["place"])
    levelled = levelled.withColumn("at", in_order)
    each = levelled.select("leaf", "line", "texts", "at", F.explode(F.array_distinct(F.transform("at", lambda p: p["level"]))).alias("from")).where("`from` >= 0")
    each = each.withColumn("template", F.transform("at", lambda p: F.when(p["level"] >= F.col("from"), p["token"]).otherwise(""))).where(_telling(depth, similarity))
    filled = F.transform("at", lambda p: F.when(p["level"] >= F.col("from"), p["token"]).otherwise(F.coalesce(F.element_at(p["fill"], F.col("from")), F.lit(""))))
    each = gathered(each.select("leaf", "line", "texts", "template", filled.alias("filled")), files)
    families = each.select("leaf", "line", F.xxhash64(F.lit(1), "leaf", "template").alias("key")).distinct()
    own = members.join(families, ["leaf", "line"]).select("doc", "body", "at", "key")

    # Templates that take similar lines, too: what most lines of a leaf have, and patterns filled up.
    found = each.groupBy("leaf", F.col("filled").alias("template")).agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs)
    all_ = most.where(_telling(depth, similarity)).unionByName(found.select("leaf", "template")).distinct()
    # The constants after the first depth tokens, which alone differ in a leaf, and how many of them a line has to have.
    tail = F.filter(F.transform("template", lambda token, place: F.struct(place.alias("place"), token.alias("token"))), lambda p: (p["place"] >= depth) & _is_constant(p["token"]))
    head = F.size(F.filter(F.slice("template", 1, depth), _is_constant))
    of_all = F.ceil(similarity * F.size("template") - 1e-9) - head
    of_tail = F.when(F.size("tail") >= MIN_CONSTANTS, F.ceil(similarity * F.size("tail") - 1e-9))
    needed = F.greatest(F.lit(0), F.least(of_all, of_tail))
    template = all_.withColumn("tail", tail).select("leaf", F.xxhash64(F.lit(2), "leaf", "template").alias("key"), "tail", needed.alias("needed"))
    template = gathered(template.where("needed <= size(tail)"), files)
    # A template that asks for none takes all lines of its leaf, so one of them does.
    whole = gathered(template.where("needed = 0").groupBy("leaf").agg(F.min("key").alias("key")).join(leaves, "leaf"), files)
    of_whole = maybe_in(members.select("doc", "body", "at", "leaf"), "leaf", bit_table(whole.select(F.col("leaf").alias("key"))), "may").where("may")
    any_line = join_by_weight(of_whole, whole, ["leaf"], "texts", lots).select("doc", "body", "at", "key")
    # A line that has enough of the constants has one of any (all - needed + 1) of them: the rarest are asked for.
    asked = template.where("needed > 0").select("leaf", "key", (F.size("tail") - F.col("needed") + 1).alias("few"), F.explode("tail").alias("p"))
    asked = asked.select("leaf", "key", "few", "p.place", "p.token")
    rank = F.row_number().over(Window.partitionBy("leaf", "key").orderBy("n", "place"))
    asked = asked.join(votes, ["leaf", "place", "token"]).withColumn("rank", rank).where("rank <= few")
    had = places.where(F.col("place") >= depth).select("leaf", "line", "place", "token")
    pairs = had.join(asked.select("leaf", "key", "place", "token"), ["leaf", "place", "token"]).select("leaf", "line", "key").distinct()
    hits = F.size(F.filter("tail", lambda p: F.get("tokens", p["place"]) == p["token"]))
    fits = pairs.join(lines, ["leaf", "line"]).join(template.select("leaf", "key", "tail", "needed"), ["leaf", "key"]).where(hits >= F.col("needed"))
    some = members.join(fits.select("leaf", "line", "key"), ["leaf", "line"]).select("doc", "body", "at", "key")
    return own.unionByName(any_line).unionByName(some)


def _telling(depth: int, similarity: float) -> Column:
    """Whether column template has enough constants to be one: the first depth tokens are alike in any leaf, so they alone tell nothing."""
    constants = F.size(F.filter("template", _is_constant))
    words = F.filter("template", lambda t: _is_constant(t) & _is_word(t))
    after = F.size(F.filter("template", lambda t, i: (i >= depth) & _is_constant(t) & _is_word(t)))
    free = F.size(F.filter("template", lambda t: t != ANY))
    return (F.size(words) >= MIN_CONSTANTS) & ((constants >= similarity * F.size("template")) | ((2 * constants >= free) & (after >= MIN_CONSTANTS)))


def _is_constant(token: Column) -> Column:
    return (token != ANY) & (token != "")


def _lines(docs: DataFrame, depth: int, min_docs: int, min_tokens: int) -> DataFrame:
    """doc, body, at, same (hash that equal lines share), leaf (null: none), need (different texts that make it recur; null: any number is too few)."""
    lines = docs.where("text is not null").select("doc", "body", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.withColumn("norm", masked(F.col("line")))
    lines = lines.withColumn("n", F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    # Scripts without spaces have no words to count: eight bytes (not quite three of their characters) are one.
    lines = lines.withColumn("weight", F.greatest("n", F.floor(F.octet_length("norm") / 8)))
    told = (F.col("norm") != "") & ((F.col("weight") >= min_tokens) | F.col("norm").rlike(r"\p{L}"))
    words = F.size(F.filter(F.split("norm", " "), _is_word))
    lines = lines.withColumn("fixed", F.when(F.contains("norm", F.lit(ANY)), words >= MIN_CONSTANTS).otherwise(True))
    return lines.select(
        "doc",
        "body",
        "at",
        F.when(F.col("fixed"), F.xxhash64("norm")).otherwise(F.xxhash64("line")).alias("same"),
        F.when(F.col("fixed") & (F.col("n") >= min_tokens), F.xxhash64("n", F.substring_index("norm", " ", depth))).alias("leaf"),
        F.when(told, _needed(F.col("weight"), min_docs, min_tokens)).cast("int").alias("need"),
    )


def _read_again(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc, body, at, leaf) with the masked tokens of its lines. Only texts that a bit table cannot rule out are exchanged."""
    per_text = wanted.groupBy("doc", "body").agg(F.collect_set(F.struct("at", "leaf")).alias("wanted"))
    texts = maybe_in(docs, "body", bit_table(per_text.select(F.col("body").alias("key"))), "may").where("may").drop("may")
    read = texts.join(per_text, ["doc", "body"]).withColumn("lines", F.split("text", "\n", -1)).select("doc", "body", "lines", F.explode("wanted").alias("w"))
    return read.select("doc", "body", "w.at", "w.leaf", masked_tokens(F.get("lines", F.col("w.at"))).alias("tokens"))


def dropped_lines(docs: DataFrame, *, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc, body, at): lines to drop, by document, hash of its text and number of the line. docs(doc, body, text).

    Only hashes of lines are counted and travel; words are read again for lines of leaves that enough texts share.
    """
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("same", "leaf")}
    lines = saved(_lines(docs, depth, min_docs, min_tokens), "lines", **plain)
    files = files_for(lines)
    lines = lines.where("need is not null")
    # (line, text), then line: what many texts share is combined before it is exchanged.
    once = lines.groupBy("same", "body").agg(F.min("doc").alias("doc"), F.min("need").alias("need"), F.min("leaf").alias("leaf"))
    each = once.groupBy("same").agg(F.count(F.lit(1)).alias("texts"), F.min("doc").alias("first"), F.min("need").alias("need"), F.min("leaf").alias("leaf"))
    equal = F.col("texts") >= F.col("need")
    # Lines that recur by themselves, and leaves whose other lines may (a text counts once for each of its lines here).
    keyed = each.select(equal.alias("equal"), F.when(equal, F.col("same")).otherwise(F.col("leaf")).alias("key"), "texts", "first")
    found = keyed.groupBy("equal", "key").agg(F.sum("texts").alias("texts"), F.min("first").alias("first"))
    found = gathered(found.where((F.col("equal") | (F.col("texts") >= min_docs)) & F.col("key").isNotNull()), files)
    lots = {r["equal"]: r["n"] for r in found.groupBy("equal").agg(F.sum("texts").alias("n")).collect()}
    equal = found.where("equal").select(F.col("key").alias("same"), "texts", "first")
    leaves = found.where("not equal").select(F.col("key").alias("leaf"), "texts")

    told = maybe_in(lines, "same", bit_table(found.where("equal")), "may_recur")
    told = maybe_in(told, "leaf", bit_table(found.where("not equal")), "may_share")
    told = told.where("may_recur or may_share").select("doc", "body", "at", "same", "may_recur", F.when(F.col("may_share"), F.col("leaf")).alias("leaf")).checkpoint()
    first_kind = join_by_weight(told.where("may_recur").select("doc", "body", "at", "same"), equal, ["same"], "texts", lots.get(True, 0))
    first_kind = first_kind.where("doc > first").select("doc", "body", "at")

    # Lines of leaves that enough texts share, with their words.
    rest = told.where("leaf is not null").join(equal.select("same"), "same", "left_anti").select("doc", "body", "at", "leaf")
    wanted = gathered(join_by_weight(rest, leaves, ["leaf"], "texts", lots.get(False, 0)).select("doc", "body", "at", "leaf"), files)
    matched = _matched(gathered(_read_again(docs, wanted), files), leaves, lots.get(False, 0), depth, similarity, min_docs, files)
    matched = gathered(matched, files)
    texts = matched.groupBy("key", "body").agg(F.min("doc").alias("doc")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("doc").alias("first"))
    general = gathered(texts.where(F.col("texts") >= min_docs), files)
    lots = general.agg(F.sum("texts")).first()[0] or 0
    second_kind = join_by_weight(matched, general, ["key"], "texts", lots).where("doc > first").select("doc", "body", "at")
    return first_kind.unionByName(second_kind)


def drop_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, with ``text`` rebuilt, as column ``row``, beside ``n_lines`` and ``n_dropped``."""
    src = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("body"),
        F.col("text").cast("string").alias("text"),
    )
    gone = dropped_lines(src.select("doc", "body", "text"), **options)
    gone = gone.groupBy("doc", "body").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    # The text travels once, within the row.
    out = src.drop("text").join(gone, ["doc", "body"], "left").withColumn("text", F.col("row").getField("text").cast("string"))
    out = out.withColumn("lines", F.split("text", "\n", -1))
    # Slices between dropped lines, one after the other: linear in the number of lines.
    ends = F.concat("gone", F.array(F.size("lines")))
    before = lambda k: F.coalesce(F.get("gone", k - 1), F.lit(-1))
    kept = F.flatten(F.transform(ends, lambda end, k: F.slice("lines", before(k) + 2, end - before(k) - 1)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(
        "row",
        text.alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for each row."""
    out = drop_recurring_lines(docs.select("doc_id", "text"), **options)
    return out.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"))


def rewritten(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with the same columns, ``text`` without its recurring lines and ``n_chars``, where present, to match."""
    out = drop_recurring_lines(docs, **options)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
