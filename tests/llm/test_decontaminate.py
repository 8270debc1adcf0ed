import hashlib
import re

from tabgauge.llm import decontaminate


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(text, items):
    ws = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        iw = words(item)
        length = min(10, len(iw))
        grams = {tuple(iw[i : i + length]) for i in range(len(iw) - length + 1)} if iw else set()
        for i in range(len(ws) - length + 1):
            if tuple(ws[i : i + length]) in grams:
                hit.update(range(i, i + length))
                if item_id is not None:
                    found.add(str(item_id))
    listed = ",".join(sorted(found))
    sha = hashlib.sha256(listed.encode()).hexdigest()
    return (len(ws), len(hit), len(found), sha, bool(hit))


DOCS = "doc_id long, text string, id int, key string, words string, term string, n_hit string"
ITEMS = "item_id long, text string, item string, key int, n string"


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "k", "w", "t", "h") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x", 1, "n") for i, t in items], ITEMS)
    found = sorted(
        (tuple(r) for r in decontaminate.contamination(d, b).collect()), key=repr
    )
    assert found == sorted(((i, *brute_force(t, items)) for i, t in docs), key=repr)


def test_edges(spark):
    item = " ".join(f"t{i}" for i in range(25))
    items = [
        (1, item), (2, "Alpha, beta-gamma!"), (3, None), (4, ""), (5, "..."), (2, "Alpha, beta-gamma!"),
        (10, item.upper()), (None, "unnamed phrase here"), (6, "the " * 12), (7, "é ü ß 東京 word"), (8, "lone"),
    ]
    docs = [
        (1, f"start {item} end"), (2, "x " + " ".join(f"t{i}" for i in range(12)) + " y"),
        (3, " ".join(f"t{i}" for i in range(9))), (4, None), (5, ""), (6, "alpha BETA gamma alpha beta gamma"),
        (7, "the " * 30), (8, "é Ü ß 東京 word é ü ß 東京 word"), (9, "unnamed phrase here"),
        (10, " ".join(f"t{i}" for i in range(15, 25)) + " lone wolf"), (1, f"start {item} end"), (1, "other"),
        (None, item), (None, None), (11, "w " * 100_000 + item), (12, "t1 " + " ".join(f"t{i}" for i in range(11))),
        (13, " ".join(f"t{i}" for i in range(25) if i != 12)),
    ]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c"), (2, None)], [])


def test_proximity_finds_a_phrase_with_an_inserted_word(spark):
    common = [(i, "the of and a to in is it " * 20) for i in range(5)]
    docs = [(100, "the of alpha and bravo it a charlie is to in"), *common]
    items = [(7, "the of alpha and bravo a charlie is to in")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.Index(d, b)
    assert [tuple(r) for r in index.proximity_matches().collect()] == [(100, "7")]
    assert index.phrase_matches().collect() == []


def test_phrases_tell_their_places(spark):
    d = spark.createDataFrame([(1, "x y one two three z")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "One two, three")], "item_id long, text string")
    rows = decontaminate.Index(d, b).phrase_matches().collect()
    assert [tuple(r) for r in rows] == [(1, "5", 2, 5)]


def test_main_path_runs_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "a b")], "item_id long, text string")
    plan = decontaminate.contamination(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
