r"""Benchmark passages in training documents, by a distributed positional index.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z in lower case. The
items are cut into windows of 10 words; a shorter item is one window.

1. Count the corpus postings of every test term (combined before the shuffle).
2. Each window keeps its rarest terms, by these counts. Windows with a term that the
   corpus lacks cannot occur and are dropped.
3. Store the postings (term, document, position) of those terms.
4. Shift each posting by the term's offset in the item: terms of one occurrence meet
   on one diagonal (item, document, start). Diagonals on which all rarest terms of
   some window meet are candidates; terms that meet on nearly the same diagonal are
   proximity matches.
5. Confirm candidates word by word against the whole item, which gives the windows
   that occur and, merged, the words hit.

Everything is DataFrame functions. Postings of a hot term are joined with the few
items that ask for it, never with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm.documents import identified, lowered, sent, without

WINDOW = 10
RAREST = 3
#: Rarest terms that lie within so many words of their places are a proximity match.
SLOP = 8
#: Up to so many test terms or documents (some 50 bytes each) are sent to all executors.
SENT_ROWS = 1_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str):
    return F.array_remove(F.split(lowered(F.col(text)), _SEPARATORS), "")


def _identified(docs: DataFrame) -> DataFrame:
    return identified(docs).withColumn("check", F.xxhash64("text"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """key, item (array of words): each different word sequence once."""
    return (
        benchmark.select(words("text").alias("item"))
        .where(F.size("item") > 0)
        .withColumn("key", F.sha2(F.array_join("item", " "), 256))
        .dropDuplicates(["key"])
    )


def _named(benchmark: DataFrame) -> DataFrame:
    """key, item_id (text), without repetitions and unnamed items."""
    return benchmark.where("item_id is not null").select(
        F.sha2(F.array_join(words("text"), " "), 256).alias("key"),
        F.col("item_id").cast("string").alias("item_id"),
    ).distinct()


def postings(own: DataFrame, terms: DataFrame, count: int) -> DataFrame:
    """id, check, pos (from 0), term: where the given terms stand in the corpus."""
    places = own.select("id", "check", F.posexplode(words("text")).alias("pos", "term"))
    return places.join(sent(terms, count, SENT_ROWS), "term")


def _windows(items: DataFrame, counts: DataFrame) -> DataFrame:
    """key, item, windows: for each window that can occur, the places of its rarest terms."""
    placed = items.select("key", F.posexplode("item").alias("place", "term"))
    counted = (
        placed.join(counts, "term", "left")
        .groupBy("key")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n")))
            ).alias("terms")
        )
    )
    length = F.least(F.lit(WINDOW), F.size("terms"))

    def rarest(start):
        window = F.slice("terms", start, length)
        few = F.slice(
            F.array_sort(F.transform(window, lambda t: F.struct(t["n"], t["place"]))), 1, RAREST
        )
        return F.struct(few[0]["n"].alias("n"), F.transform(few, lambda t: t["place"]).alias("at"))

    every = F.transform(F.sequence(F.lit(1), F.size("terms") - length + 1), rarest)
    possible = F.transform(F.filter(every, lambda w: w["n"] > 0), lambda w: w["at"])
    return (
        items.join(counted.select("key", F.array_distinct(possible).alias("windows")), "key")
        .where(F.size("windows") > 0)
        .select("key", "item", "windows")
    )


def _diagonals(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """id, check, key, place, start: postings shifted to where the item would start."""
    places = asked.select("key", F.explode(F.array_distinct(F.flatten("windows"))).alias("place"), "item")
    places = places.select("key", "place", F.col("item")[F.col("place")].alias("term"))
    return stored.join(places, "term").select(
        "id", "check", "key", "place", (F.col("pos") - F.col("place")).alias("start")
    )


def _meeting(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """Groups (key, places) in which all rarest terms of some window meet."""
    meets = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("places"))) == 0)
    return groups.join(asked.select("key", "windows"), "key").where(meets).drop("windows", "places")


class Index:
    """The stored postings of the rarest test terms, and what to look up in them."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame) -> None:
        self.docs = _identified(docs)
        self.benchmark = benchmark
        items = settled(items_of(benchmark))
        terms = settled(items.select(F.explode("item").alias("term")).distinct())
        counts = postings(self.docs, terms, terms.count()).groupBy("term").agg(F.count("*").alias("n"))
        self.asked = settled(_windows(items, settled(counts)))
        rare = self.asked.select(
            F.explode(
                F.transform(
                    F.array_distinct(F.flatten("windows")), lambda place: F.col("item")[place]
                )
            ).alias("term")
        ).distinct()
        rare = settled(rare)
        self.diagonals = _diagonals(settled(postings(self.docs, rare, rare.count())), self.asked)

    def occurrences(self) -> DataFrame:
        """id, check, key, first, last: windows that occur, as word positions, end exclusive."""
        same = self.diagonals.groupBy("key", "id", "check", "start").agg(
            F.collect_set("place").alias("places")
        )
        lengths = self.asked.select("key", F.size("item").alias("n"))
        found = settled(_meeting(same, self.asked).join(lengths, "key"))
        per_doc = found.groupBy("id", "check").agg(
            F.collect_list(F.struct("key", "start", "n")).alias("found")
        )
        holders = settled(per_doc.select("id", "check"))
        holding = self.docs.join(sent(holders, holders.count(), SENT_ROWS), ["id", "check"], "left_semi")
        holding = holding.dropDuplicates(["id", "check"]).join(per_doc, ["id", "check"])
        held = holding.select("id", "check", words("text").alias("words"), "found")

        def part(f):
            first = F.greatest(f["start"], F.lit(0))
            length = f["start"] + f["n"] - first
            text = F.slice("words", first + 1, length)
            return F.struct(f["key"].alias("key"), f["start"].alias("start"), first.alias("from"), text.alias("part"))

        parts = held.select("id", "check", F.inline(F.transform("found", part)))
        flags = F.array_join(
            F.transform(
                "part",
                lambda w, i: F.when(
                    w == F.col("item")[F.col("from") - F.col("start") + i], "1"
                ).otherwise("0"),
            ),
            "",
        )
        length = F.least(F.lit(WINDOW), F.size("item"))
        starts = F.filter(
            F.sequence(F.lit(0), F.length("flags") - F.col("length")),
            lambda i: F.substring("flags", i + 1, F.col("length")) == F.repeat(F.lit("1"), F.col("length")),
        )
        return (
            parts.join(self.asked.select("key", "item"), "key")
            .select("id", "check", "key", "from", flags.alias("flags"), length.alias("length"))
            .where("length(flags) >= length")
            .select("id", "check", "key", "from", "length", F.explode(starts).alias("i"))
            .select(
                "id",
                "check",
                "key",
                (F.col("from") + F.col("i")).alias("first"),
                (F.col("from") + F.col("i") + F.col("length")).alias("last"),
            )
        )

    def phrase_matches(self) -> DataFrame:
        """doc_id, item_id, first, last for each window of an item that occurs."""
        ids = self.docs.select("id", "check", "doc_id")
        return self.occurrences().join(_named(self.benchmark), "key").join(ids, ["id", "check"]).select(
            "doc_id", "item_id", "first", "last"
        )

    def proximity_matches(self) -> DataFrame:
        """doc_id, item_id: all rarest terms of some window within SLOP words of their places."""
        grids = F.explode(
            F.array(
                F.struct(F.lit(0).alias("grid"), F.floor(F.col("start") / SLOP).alias("cell")),
                F.struct(F.lit(1).alias("grid"), F.floor((F.col("start") + SLOP // 2) / SLOP).alias("cell")),
            )
        )
        near = (
            self.diagonals.select("id", "check", "key", "place", grids.alias("at"))
            .groupBy("key", "id", "check", "at")
            .agg(F.collect_set("place").alias("places"))
        )
        ids = self.docs.select("id", "check", "doc_id")
        found = _meeting(near, self.asked).select("id", "check", "key").distinct()
        return (
            found.join(_named(self.benchmark), "key")
            .join(ids, ["id", "check"])
            .select("doc_id", "item_id")
            .distinct()
        )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    * Null and empty texts have no words; items without words are not looked for.
    * Items without an item_id hit words but are not counted or listed; items of equal
      words are found together and listed each; a repeated item_id is listed once.
    * Repeated rows and null doc_ids get the result of their own text. Other columns
      are not looked at. Empty tables give no rows, or no hits.
    """
    return contamination_by_row(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def contamination_by_row(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of `contamination`, with id and check, which tell a row's text."""
    index = Index(docs, benchmark)
    found = settled(index.occurrences())
    of_doc = ["id", "check"]
    before = Window.partitionBy(*of_doc).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.groupBy(*of_doc, "first")
        .agg(F.max("last").alias("last"))
        .withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(0)))
        .groupBy(*of_doc)
        .agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", "seen"))).alias("n_hit"))
    )
    items = (
        found.select(*of_doc, "key")
        .distinct()
        .join(_named(benchmark), "key")
        .groupBy(*of_doc)
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    hits = covered.join(items, of_doc, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        index.docs.select(*of_doc, "doc_id", F.coalesce(F.size(words("text")), F.lit(0)).alias("n_words"))
        .withColumn("n_words", F.greatest("n_words", F.lit(0)).cast("long"))
        .join(hits, of_doc, "left")
        .select(
            *of_doc,
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark window hits, with all their columns."""
    hit = settled(contamination_by_row(docs, benchmark).where("contaminated").select("id", "check"))
    return without(docs, hit, SENT_ROWS, check=F.xxhash64("text"))
