import random
import re

import pytest

from tabgauge.llm import licenses
from tabgauge.llm.license_texts import TEMPLATES


def brute_force(text):
    """All templates against all shingles, with words as text."""
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower)
    placed = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = []
    for name, template in TEMPLATES.items():
        tw = re.findall(r"[a-z0-9]+", template.lower())
        wanted = {tuple(tw[i : i + 3]) for i in range(len(tw) - 2)}
        groups, last = [], None
        for i in (i for i, s in enumerate(placed) if s in wanted):
            if last is None or i - last > len(wanted) // 4 + 3:
                groups.append([])
            groups[-1].append(i)
            last = i
        for group in groups:
            if 100 * len({placed[i] for i in group}) >= 75 * len(wanted):
                found.append((group[0], group[-1] + 3, name))
    return ",".join(f"{name}:{a}:{b}" for a, b, name in sorted(found))


def test_documents_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r.spans for r in licenses.licenses(docs).collect()}
    assert found == {i: brute_force(t) for i, t in texts.items()}
    assert sum(map(bool, found.values())) > 20


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_edited_texts_are_retrieved(edits):
    rng = random.Random(edits)
    templates = licenses.Templates(TEMPLATES)
    missed = total = 0
    for _ in range(20):
        for name, text in TEMPLATES.items():
            words = text.split()
            if len(words) < 30 and edits:
                continue
            for _ in range(edits):
                words[rng.randrange(len(words))] = "changed"
            before = " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(60)))
            doc = f"{before} {' '.join(words)} {before}"
            total += 1
            missed += templates.scan(doc) != templates.scan(doc, every=True)
            if not edits:
                assert name in {n for _, _, n, _ in templates.scan(doc)}
    assert missed <= 0.01 * total


def test_edges(spark):
    mit = TEMPLATES["mit"]
    texts = [
        None, "", "All rights", "ALL RIGHTS RESERVED!!!", mit + " " + mit, ("x " * 200_000) + mit, "é東京 all  rights\nreserved é",
        mit.replace(" ", "\n* "),
    ]
    schema = "doc_id long, text string, name string, spans int, matches int"
    table = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in enumerate(texts)] + [(None, mit, "n", 1, 2)] * 2, schema)
    rows = licenses.licenses(table).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = mit if r.doc_id is None else texts[r.doc_id]
        assert r.spans == brute_force(text)
        assert r.n_licenses == len(set(re.findall(r"([^,:]+):\d+:\d+", r.spans)))
    assert licenses.licenses(table.limit(0)).collect() == []
