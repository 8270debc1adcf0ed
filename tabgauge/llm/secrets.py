r"""Secrets in texts: known forms, and strings whose characters look random.

Base spans are leftmost non-overlapping matches per kind (fixed patterns below). The
method adds spans: candidate strings are runs of one character class; a window slides
over each candidate, the counts of its characters are kept up to date as one enters
and one leaves, and with them the Shannon entropy. Stretches whose windows reach the
class's entropy become spans, unless a base span covers them already. Allow-list entries
take their matches out of a candidate, one entry after the other; what stands before,
between and after is scored, so that known words do not hide a key beside them.

All is DataFrame functions on one row at a time: nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of the contract, and the least length of the part that counts.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (
    # kind, pattern, group whose length counts, least length
    ("assign", ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)


@dataclass(frozen=True)
class CharacterClass:
    """Runs of these characters are candidates; a window of them must reach the entropy."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]


LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
CLASSES = (
    CharacterClass(
        "entropy_hex", r"[0-9A-Fa-f]{20,}", DIGITS + "abcdef", 20, 2.9, ("[0-9]", "[A-Fa-f]")
    ),
    CharacterClass(
        "entropy_base64",
        r"[A-Za-z0-9+/_-]{20,}={0,2}",
        DIGITS + LOWER + LOWER.upper() + "+/_-=",
        20,
        3.7,
        ("[0-9]", "[a-z]", "[A-Z]"),
    ),
)

#: Three or more whole words in lower case, as in the name of a file.
WORDS_PATH = r"(?-i:(?<![A-Za-z0-9])[a-z]{3,}(?:[/_-][a-z]{3,}){2,}(?![A-Za-z0-9]))"
#: Parts of candidates that are known not to be secrets (searched in either case).
ALLOWED = (
    r"example", r"placeholder", r"changeme", r"your[_-]?(api|key|token|secret)", r"x{6,}",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"0123456789",
    r"abcdefghij", WORDS_PATH, r"(.)\1{7,}",
)

#: Entropies are compared as whole numbers of this part of a bit.
_UNIT = 1_000_000
#: Spans are gathered in lists of this length, so that gathering stays linear.
_LIST = 256

_FOUND = "struct<start:int,end:int,value:string>"
_ORDER = [b[0] for b in BASE] + [c.kind for c in CLASSES]


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _located(text: Column, pattern: str, whole: Column, counted: Column, keeps) -> Column:
    """start, end, value of the matches that keeps(counted) holds for, in code points.

    The pieces between matches and the matches themselves tell all places.
    """
    steps = F.slice(
        F.zip_with(
            F.split(text, pattern, -1),
            F.arrays_zip(whole.alias("whole"), counted.alias("counted")),
            lambda piece, m: F.struct(
                F.length(piece).alias("before"), m["whole"].alias("value"), m["counted"].alias("counted")
            ),
        ),
        1,
        F.size(whole),
    )

    def step(state, m):
        start = state["at"] + m["before"]
        end = start + F.length(m["value"])
        found = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        full = F.size(state["some"]) >= _LIST
        some = F.when(full, _none(_FOUND)).otherwise(state["some"])
        return F.struct(
            end.alias("at"),
            F.when(full, F.concat(state["done"], F.array(state["some"])))
            .otherwise(state["done"])
            .alias("done"),
            F.when(keeps(m["counted"]), F.concat(some, F.array(found))).otherwise(some).alias("some"),
        )

    empty = F.struct(
        F.lit(0).alias("at"), _none(f"array<{_FOUND}>").alias("done"), _none(_FOUND).alias("some")
    )
    gathered = F.aggregate(
        steps, empty, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["some"])))
    )
    return F.when(F.exists(counted, keeps), gathered).otherwise(_none(_FOUND))


def _gains(window: int) -> list[int]:
    """Change of the sum of n * log2(n) when a character's count grows to n."""
    sums = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    return [0] + [round((sums[n] - sums[n - 1]) * _UNIT) for n in range(1, window + 1)]


def random_stretches(value: Column, of: CharacterClass) -> Column:
    """Stretches (start, end) of a string whose windows all reach the class's entropy.

    The state of the walk is the count of each character of the alphabet in the
    window, and the sum of n * log2(n) over them; the entropy of a window of w
    characters is log2(w) - sum / w. Each step changes two counts.
    """
    w = of.window
    most = round((math.log2(w) - of.bits) * w * _UNIT)
    gains = F.array(*[F.lit(g).cast("long") for g in _gains(w)])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(of.alphabet), c) - 1)
    codes = F.slice(codes, 1, F.length(value))
    steps = F.zip_with(
        codes,
        F.slice(F.concat(F.array_repeat(F.lit(-1), w), codes), 1, F.length(value)),
        lambda entering, leaving: F.struct(entering.alias("entering"), leaving.alias("leaving")),
    )
    stretch = "struct<start:int,end:int>"

    def step(state, c):
        entering, leaving = c["entering"], c["leaving"]
        without = F.when(leaving >= 0, F.get(state["counts"], leaving)).otherwise(0)
        had = F.get(state["counts"], entering) - F.when(leaving == entering, 1).otherwise(0)
        total = state["sum"] - F.get(gains, without) + F.get(gains, had + 1)
        counts = F.transform(
            state["counts"],
            lambda n, k: n
            + F.when(k == entering, 1).otherwise(0)
            - F.when(k == leaving, 1).otherwise(0),
        )
        end = state["end"] + 1
        last = F.get(state["found"], F.size(state["found"]) - 1)
        joins = F.coalesce(last["end"] >= end - w, F.lit(False))
        here = F.struct(
            F.when(joins, last["start"]).otherwise(end - w).alias("start"), end.alias("end")
        )
        before = F.slice(state["found"], 1, F.size(state["found"]) - F.when(joins, 1).otherwise(0))
        return F.struct(
            end.alias("end"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when((end >= w) & (total <= most), F.concat(before, F.array(here)))
            .otherwise(state["found"])
            .alias("found"),
        )

    empty = F.struct(
        F.lit(0).alias("end"),
        F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        _none(stretch).alias("found"),
    )
    return F.aggregate(steps, empty, step, lambda s: s["found"])


def _at_least(length: int):
    return lambda value: F.length(value) >= length


def _candidate(of: CharacterClass):
    """Whether a string has what the class needs."""

    def test(value):
        fits = F.lit(True)
        for needed in of.needs:
            fits = fits & F.rlike(value, F.lit(needed))
        return fits

    return test


def _without_allowed(found: Column, of: CharacterClass, allowed: tuple[str, ...]) -> Column:
    """The pieces (start, end, value) between allow-list matches that hold a window."""

    def cut(entry):
        def pieces(m):
            value, pattern = m["value"], "(?i)" + entry
            whole = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
            known = _located(value, pattern, whole, whole, _at_least(1))
            starts = F.concat(F.array(F.lit(0)), F.transform(known, lambda k: k["end"]))
            between = F.zip_with(
                F.split(value, pattern, -1),
                starts,
                lambda piece, at: F.struct(
                    (m["start"] + at).alias("start"),
                    (m["start"] + at + F.length(piece)).alias("end"),
                    piece.alias("value"),
                ),
            )
            return F.filter(between, lambda b: F.length(b["value"]) >= of.window)

        return pieces

    for entry in allowed:
        found = F.flatten(F.transform(found, cut(entry)))
    return found


def with_spans(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The table with the columns _text (null: empty) and _spans (start, end, kind).

    An allow-list entry suppresses its match; what stands before and after is searched.
    Spans are ordered by start, then by kind: assign, access, hex, then the kinds of
    CLASSES. Places are in code points, ends exclusive.
    """
    table = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("_text")
    # A run of at least n characters is the same as a run of them that has n.
    wanted = {
        kind: (pattern if group else f"{pattern[:-1]}{{{least - len(pattern.split('[')[0])},}}", group)
        for kind, pattern, group, least in BASE
    } | {of.kind: (of.pattern, 0) for of in CLASSES}
    table = table.withColumns(
        {
            f"_{kind}": F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            for kind, (pattern, _) in wanted.items()
        }
    )
    found = {}
    for kind, pattern, group, least in BASE:
        counted = F.col(f"_{kind}")
        if group:
            counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        located = _located(text, wanted[kind][0], F.col(f"_{kind}"), counted, _at_least(least))
        none = _none(_FOUND)
        found[f"_{kind}"] = F.when(F.size(f"_{kind}") > 0, located).otherwise(none)
    for of in CLASSES:
        whole = F.col(f"_{of.kind}")
        located = _located(text, of.pattern, whole, whole, _candidate(of))
        found[f"_{of.kind}"] = _without_allowed(located, of, allowed)
    table = table.withColumns(found)

    def spans(kind):
        return F.transform(
            F.col(f"_{kind}"), lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind"))
        )

    base = F.concat(*[spans(kind) for kind, *_ in BASE])
    table = table.withColumn("_base", base)

    def added(of: CharacterClass):
        def within(m):
            value = F.lower(m["value"]) if of.kind == "entropy_hex" else m["value"]
            return F.transform(
                random_stretches(value, of),
                lambda s: F.struct(
                    (m["start"] + s["start"]).alias("start"),
                    (m["start"] + s["end"]).alias("end"),
                    F.lit(of.kind).alias("kind"),
                ),
            )

        return F.filter(
            F.flatten(F.transform(F.col(f"_{of.kind}"), within)),
            lambda s: ~F.exists(
                "_base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])
            ),
        )

    order = F.array(*[F.lit(kind) for kind in _ORDER])
    every = F.concat("_base", *[added(of) for of in CLASSES])
    ranked = F.transform(
        every,
        lambda s: F.struct(
            s["start"], F.array_position(order, s["kind"]).alias("rank"), s["end"], s["kind"]
        ),
    )
    ordered = F.transform(
        F.array_sort(ranked), lambda s: F.struct(s["start"], s["end"], s["kind"])
    )
    return table.withColumn("_spans", ordered).drop(*[f"_{kind}" for kind in wanted], "_base")


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row.

    Null and empty texts have no spans. Repeated rows and null ids keep their rows;
    other columns are not looked at; an empty table gives no rows. Texts are searched
    whole, whatever their length.
    """
    base = [b[0] for b in BASE]
    held = F.filter("_spans", lambda s: s["kind"].isin(base))

    def number(kinds):
        return F.size(F.filter("_spans", lambda s: s["kind"].isin(kinds))).cast("long")

    return with_spans(docs.select("doc_id", "text"), allowed).select(
        "doc_id",
        number(["assign"]).alias("n_assign"),
        number(["access"]).alias("n_access"),
        number(["hex"]).alias("n_hex"),
        F.sha2(_listed(held), 256).alias("base_sha256"),
        _listed(F.col("_spans")).alias("spans"),
        number([of.kind for of in CLASSES]).alias("n_entropy"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by the mark."""

    def step(state, s):
        apart = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["parts"], F.array(between))).otherwise(state["parts"]).alias("parts"),
        )

    empty = F.struct(F.lit(0).alias("at"), _none("string").alias("parts"))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans,
            empty,
            step,
            lambda s: F.array_join(
                F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), mark
            ),
        )
    )


def redact(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs, all its columns, with the mark in place of every span found in text.

    Secrets that touch an allow-list match without a break are replaced too.
    n_chars, where there is such a column, is set to the new length of changed texts.
    Null texts stay null.
    """
    found = with_spans(docs.select(F.struct("*").alias("row"), "text"), allowed)
    changed = F.size("_spans") > 0
    new = F.when(changed, redacted(F.col("_text"), F.col("_spans"))).otherwise(F.col("text"))
    found = found.withColumn("_new", new)
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.col("_new")
    if "n_chars" in columns:
        length = F.length("_new").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(changed, length).otherwise(columns["n_chars"])
    return found.select(*[value.alias(c) for c, value in columns.items()])
