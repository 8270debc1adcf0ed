import zlib
from types import SimpleNamespace

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabgauge.llm import language

SCHEMA = "doc_id long, text string, lang string, held_out int, score string, place string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language.languages(docs.repartition(3)).collect()}
    labels = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(rows) == set(labels)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    tested = [i for i in rows if rows[i].held_out]
    right = sum(rows[i].lang_pred == labels[i] for i in tested)
    assert right >= 0.97 * len(tested)


def test_labels_are_no_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r for r in language.languages(docs).collect()}
    hidden = docs.withColumn("lang", F.when(~language.held_out(), F.col("lang")))
    assert {r.doc_id: r for r in language.languages(hidden).collect()} == before


def test_smallest_size_wins():
    sizes = language.Sizes({"a": b"the quick brown fox jumps over the lazy dog " * 5, "b": b"zzz qqq " * 20})
    found = sizes.of("The quick brown fox jumps over the lazy dog")
    assert found[0] < found[1]
    assert language.decided(found, ["a", "b"])[0] == "a"
    assert language.decided(found * 0 + 7, ["a", "b"]) == ("a", 0.0, False)
    whole = "the quick brown fox " * 2000
    assert sizes.of(whole)[0] == sum(sizes.of(whole[i : i + language.BLOCK])[0] for i in range(0, len(whole), language.BLOCK))


def test_edges(spark):
    rows = [
        (0, "the and of to in that is was", "en"), (1, None, "en"), (2, "", None), (3, "123 ... !!", "de"),
        (4, "der die das und ist nicht ein", "de"), (6, "the of and", None), (7, "word " * 200_000, "en"),
        (8, "é", "fr"), (8, "é", "fr"), (None, "der die das", "xx"), (10, "ﬀ 東京", "en"),
    ]
    table = spark.createDataFrame([(*r, 1, "s", "p") for r in rows], SCHEMA)
    found = language.languages(table).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    learned = {lang for i, t, lang in rows if i is not None and lang and zlib.crc32(str(i).encode()) % 5 and language._has_letter(t)}
    for i, text, _ in rows:
        wanted = learned if language._has_letter(text) else {"und"}
        assert by_id[i].lang_pred in wanted
        assert by_id[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    assert language.languages(table.limit(0)).collect() == []


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.languages(table).collect()] == [(1, False, "und", 0.0, False)]


def test_a_dictionary_serves_many_texts_in_turn(monkeypatch):
    used = []

    class Compressor:
        def __init__(self, make=zstandard.ZstdCompressor, **options):
            self.own = make(**options)

        def compress(self, data):
            used.append(id(self))
            return self.own.compress(data)

    words = {"a": "the quick brown fox ", "b": "der schnelle braune Fuchs ", "c": "le renard brun "}
    texts = [None if k % 11 == 0 else "1 2" if k % 7 == 0 else words["abc"[k % 3]] * k for k in range(300)]
    found = {lang: text.encode() * 9 for lang, text in words.items()}
    sizes = language.Sizes(found)
    expected = [
        language.decided(sizes.of(t), list(found)) if language._has_letter(t) else ("und", 0.0, False) for t in texts
    ]
    monkeypatch.setattr(language.zstandard, "ZstdCompressor", Compressor)
    monkeypatch.setattr(language, "TURN", 100_000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array([False] * 300), pa.array(texts, pa.string())], names=["doc_id", "held_out", "text"]
    )
    (rows,) = language._predicted(SimpleNamespace(value=found))([batch])
    assert [tuple(r.values())[2:] for r in rows.to_pylist()] == expected
    turns = sum(len(language._encoded(t or "")) for t in texts) // language.TURN + 1
    assert sum(a != b for a, b in zip(used, used[1:])) < turns * len(found)


@pytest.mark.parametrize("group", [1, 2])
def test_groups_of_languages(spark, monkeypatch, group):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r for r in language.languages(docs).collect()}
    monkeypatch.setattr(language, "LANGUAGES", group)
    assert {r.doc_id: r for r in language.languages(docs).collect()} == before


def test_every_sample_is_in_the_dictionary_in_every_script(monkeypatch):
    class Samples(list):
        def distinct(self):
            return self

        def toLocalIterator(self):
            return iter(self)

    rows = [
        Row(lang=lang, place=k, text=f"{k} " + letter * (language.SAMPLE_CHARS - len(f"{k} ")), n=1)
        for lang, letter in (("en", "a"), ("el", "α"), ("hi", "क"), ("zh", "東"))
        for k in range(language.SAMPLE)
    ]
    monkeypatch.setattr(language, "sample", lambda docs: Samples(rows))
    for lang, data in language.dictionaries(None).items():
        assert len(data) <= language.DICTIONARY
        starts = [part.split(" ")[0] for part in data.decode().split("\n")]
        assert starts == [str(k) for k in range(language.SAMPLE)], lang
    assert language.dictionaries(None)["en"].decode() == "\n".join(r.text for r in rows if r.lang == "en")
