"""Offset maps and quotations against plain computations, character by character."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.functions import text as T
from proofmill.operators import offsets, spans
from proofmill.tables import read_table


def plain_form(text):
    """The rules one after the other, each with the place that every character came from."""
    chars = [(d, i) for i, c in enumerate(text) for d in unicodedata.normalize("NFKC", c)]
    chars = [(e, i) for c, i in chars for e in T.LIGATURES.get(c, c)]
    chars = [("-" if c in T.DASHES else "'" if c in T.SINGLE_QUOTES else '"' if c in T.DOUBLE_QUOTES else c, i) for c, i in chars]
    chars = [(c, i) for c, i in chars if c not in T.INVISIBLE]
    out, k = [], 0
    while k < len(chars):
        if chars[k][0] == "-":
            at = k + 1
            while at < len(chars) and chars[at][0] in " \t":
                at += 1
            if at < len(chars) and chars[at][0] == "\n":
                at += 1
                while at < len(chars) and chars[at][0] in " \t":
                    at += 1
                if at < len(chars) and chars[at][0].islower():
                    k = at
                    continue
        out.append(chars[k])
        k += 1
    kept = []
    for c, i in out:
        if not c.isspace():
            kept.append((c, i))
        elif kept and kept[-1][0] != " ":
            kept.append((" ", i))
    if kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


PIECES = st.text(st.sampled_from(list("ab-\n \t.é") + ["ﬁ", "“", "–", "­", "​", "　", "Ⅳ", "½", "\u0085", "É", "æ"]), max_size=40)


@given(PIECES)
@settings(max_examples=400, deadline=None)
def test_normal_form_is_that_of_the_rules(text):
    form, places = offsets.normal_form(text)
    assert (form, places.tolist()) == plain_form(text)


TEXTS = [(1, "The team rede-\nsigned the ﬁle – “fast” — and   went on.\n\nEnd-\nOf it"), (2, ""), (3, None), (4, " \n "), (5, "x" * 5000 + "\n\n" + "ﬁ " * 3000), (6, "­a\u0085b")]


@pytest.fixture(scope="module")
def mapped(spark):
    return offsets.normalise_with_map(spark.createDataFrame(TEXTS, "id bigint, text string").repartition(2))


def plain_norm_at(places, raw):
    return next((n for n, i in enumerate(places) if i >= raw), len(places))


def test_bounds_are_carried_through_the_map(mapped):
    got = {(r["id"], r["kind"], r["nth"]): (r["start"], r["stop"]) for r in offsets.carried_bounds(mapped).collect()}
    want = {}
    for i, text in TEXTS:
        text = text or ""
        _, places = plain_form(text)
        starts = [plain_norm_at(places, at) for at in range(0, len(text), offsets.PAGE_CHARS)]
        want |= {(i, "page", n): (a, b) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(places)]))}
        at = 0
        for n, line in enumerate(text.split("\n") if text else []):
            a, b = plain_norm_at(places, at), plain_norm_at(places, at + len(line))
            at += len(line) + 1
            want |= {(i, "block", n): (a, b)} if a < b else {}
    assert got == want and len([k for k in want if k[1] == "page"]) > 5


def test_places_are_translated_both_ways_or_refused(spark, mapped):
    runs = offsets.runs_of(mapped)
    points = spark.createDataFrame([(i, at) for i, _ in TEXTS for at in (-1, 0, 1, 9, 12, 13, 30, 2047, 2048, 5000, 5003, 7000, 10**6)], "id bigint, at bigint")
    raw = {(r["id"], r["at"]): r["raw"] for r in offsets.to_raw(points, runs).collect()}
    norm = {(r["id"], r["at"]): r["norm"] for r in offsets.to_norm(points, runs).collect()}
    for i, text in TEXTS:
        _, places = plain_form(text or "")
        for (j, at), value in raw.items():
            if i == j:
                assert value == (places[at] if 0 <= at < len(places) else None)
        for (j, at), value in norm.items():
            if i == j:
                assert value == (places.index(at) if at in places else None)
    asked = spark.createDataFrame([(1, 0, 8), (1, 8, 8), (1, 5, 10**4), (4, 0, 1), (5, 4990, 5010)], "id bigint, start bigint, stop bigint")
    found = {(r["id"], r["start"]): (r["raw_start"], r["raw_stop"], r["error"]) for r in offsets.raw_spans(asked, runs).collect()}
    places = plain_form(TEXTS[4][1])[1]
    refused = (None, None, offsets.OUT_OF_RANGE)
    assert found == {(1, 0): (0, 8, None), (1, 8): refused, (1, 5): refused, (4, 0): refused, (5, 4990): (places[4990], places[5009] + 1, None)}


# -- quotations


def plain_ratio(needle, text):
    if not needle or not text:
        return 0.0
    n = len(needle)
    windows = [text] if n >= len(text) else [text[i : i + n] for i in range(0, len(text) - n + 1, max(1, n // 4))]
    return max(SequenceMatcher(None, needle, w).ratio() for w in windows)


def plain_check(claim, docs, fold):
    """A claim's verdict, ratio, place and crossing by the rules, one step after the other."""
    if not claim["span"]:
        return spans.ABSENT, None, None, False
    if claim["cited"] not in docs:
        return "wrong_document", 0.0, None, False
    raw = docs[claim["cited"]]
    text, places = plain_form(raw)
    needle = plain_form(claim["span"])[0]
    if not needle:
        return "not_found", 0.0, None, False
    blocks, at = [], 0
    for line in raw.split("\n"):
        a, b = plain_norm_at(places, at), plain_norm_at(places, at + len(line))
        at += len(line) + 1
        blocks += [(a, b)] if a < b else []

    def crosses(start, stop):
        return next((stop > b for a, b in blocks if a <= start < b), False)

    claimed = claim["claimed"]
    own = crosses(claimed, claim["claimed_stop"])
    if text[claimed : claimed + len(needle)] == needle:
        return "exact", 1.0, claimed, own
    found = [i for i in range(len(text)) if text.startswith(needle, i)]
    if found:
        best = min(found, key=lambda i: abs(i - claimed))
        if len(found) == 1 or abs(best - claimed) <= spans.TOLERANCE:
            return "relocated", 1.0, best, crosses(best, best + len(needle))
        return "offset_mismatch", None, None, own
    starts = [plain_norm_at(places, p) for p in range(0, len(raw), offsets.PAGE_CHARS)]
    pages = list(zip(starts, [*starts[1:], len(text)]))
    page = next((n for n, (a, b) in enumerate(pages) if a <= claimed < b), 0)
    ocr = claim["cited"] % 3 == 0 and page % 2 == 0
    reach = max(2 * len(needle), spans.RADIUS)
    near = text[max(0, claimed - reach) : claimed + reach]
    form, enough = (fold, spans.OCR_THRESHOLD) if ocr else (lambda x: x, spans.THRESHOLD)
    ratio = plain_ratio(form(needle), form(near))
    ratio = ratio if ratio >= enough else max(ratio, plain_ratio(form(needle), form(text)))
    if ratio >= enough:
        return "fuzzy_ocr" if ocr else "fuzzy", ratio, claimed, own
    return "not_found", ratio, None, own


def plain_fold(text):
    text = text.lower().translate(str.maketrans(T.CONFUSED, T.FOLDED))
    for pair, one in T.PAIRS:
        text = text.replace(pair, one)
    return "".join(text.split())


def test_every_verdict_is_that_of_the_rules(spark, data):
    """All claims of the smallest tables: curly quotes, doubled blanks, line breaks, misread, reversed and absent ones."""
    docs = {r["doc_id"]: r["text"] or "" for r in read_table(spark, data, "documents").collect()}
    asked = {r["claim_id"]: r.asDict() for r in spans.claims(spark, data).collect()}
    got = {r["claim_id"]: r for r in spans.span_checks(spark, data).collect()}
    assert set(got) == set(asked) == set(docs)
    seen = set()
    for i, claim in asked.items():
        verdict, ratio, place, crosses = plain_check(claim, docs, plain_fold)
        seen.add((i % 8, verdict))
        assert (got[i]["verdict"], got[i]["place"], got[i]["crosses"]) == (verdict, place, crosses), claim
        assert (got[i]["ratio"] is None) == (ratio is None) and (ratio is None or abs(got[i]["ratio"] - ratio) < 1e-4)
        assert got[i]["accepted"] == (verdict in (*spans.VALID, spans.ABSENT))
    assert {(0, "exact"), (5, "exact"), (6, "relocated"), (7, spans.ABSENT), (4, "wrong_document")} <= seen and any(v.startswith("fuzzy") for _, v in seen) and any(v == "not_found" for _, v in seen)


def test_awkward_quotations(spark):
    """Overlaps, marks of patterns, quotes and hyphens in another typography, blanks alone, and blocks."""
    docs = [
        (1, "ababab" + "x" * 900), (2, "a \\E b \\Q c (d) " + "y" * 50), (4, "one\ntwo three"), (5, "He said “yes”  to it\nand left – at once"),
        (7, "rede-\nsigned " * 3 + "end"), (8, ""), (10, "dog " * 300),
    ]
    asked = [
        (1, 1, "abab", 800, 804), (2, 2, "\\E b", 30, 34), (3, 2, "(d)", 0, 3), (4, 4, "one two", 0, 7), (5, 9, "x", 0, 1), (6, 4, "two", 9, 12), (7, 5, 'He said "yes" to it', 0, 19),
        (8, 5, "to  it and left - at", 3, 20), (9, 7, "redesigned", 900, 910), (10, 5, " ​ ", 0, 3), (11, 8, "words", 0, 5), (12, 10, "dog", 5000, 5003), (13, 5, None, 0, 0), (14, 5, "", 0, 0),
    ]
    claims = spark.createDataFrame(asked, "claim_id bigint, cited bigint, span string, claimed int, claimed_stop int")
    frame = spark.createDataFrame(docs, "id bigint, text string")
    got = {r["claim_id"]: (r["verdict"], r["place"], r["crosses"]) for r in spans.verified(claims, frame).collect()}
    names = ("claim_id", "cited", "span", "claimed", "claimed_stop")
    want = {row[0]: plain_check(dict(zip(names, row)), dict(docs), plain_fold) for row in asked}
    assert got == {i: (v, p, c) for i, (v, _, p, c) in want.items()}
    assert got[7][0] == "exact" and got[8] == ("relocated", 14, True) and got[4] == ("exact", 0, True) and got[9][0] == "offset_mismatch" and got[12][0] == "offset_mismatch"
    assert spans.verified(claims.where("claim_id < 0"), frame).count() == 0 and spans.verified(claims, frame.where("id < 0")).where("verdict = 'wrong_document'").count() == 12


def test_evidence_is_dropped_accepted_or_rejected(spark, data):
    asked = {r["claim_id"]: r["span"] for r in spans.claims(spark, data).collect()}
    verdicts = {r["claim_id"]: r["verdict"] for r in spans.span_checks(spark, data).collect()}
    protected = {r["claim_id"] for r in spans.claims(spark, data).where(F.size(T.protected_terms(F.col("span"))) > 0).collect()}
    want = {}
    for i, span in asked.items():
        fate = "protected" if i in protected else "invalid" if span is not None and not spans.SHORTEST <= len(span) <= spans.LONGEST else "accepted" if verdicts[i] in (*spans.VALID, spans.ABSENT) else "rejected"
        key = (fate, verdicts[i] if fate in ("accepted", "rejected") else None)
        want[key] = want.get(key, 0) + 1
    assert {(r["fate"], r["verdict"]): r["n"] for r in spans.evidence_build(spark, data).collect()} == want
    assert {f for f, _ in want} >= {"accepted", "rejected", "invalid"}


def test_sweep_takes_the_least_total_error(spark, data):
    checked = {r["claim_id"]: r for r in spans.span_checks(spark, data).collect() if r["claim_id"] % 8 in (2, 3)}
    got = {(r["method"], round(r["threshold"], 2)): r for r in spans.threshold_sweep(spark, data).collect()}
    for method in {r["method"] for r in checked.values()}:
        mine = {i: r["ratio"] or 0.0 for i, r in checked.items() if r["method"] == method}
        points = []
        for k in range(70, 101, 2):
            real, false = ([x for i, x in mine.items() if i % 8 == kind] for kind in (2, 3))
            kept, caught = sum(x >= k / 100 for x in real), sum(x < k / 100 for x in false)
            row = got[method, k / 100]
            assert (row["kept"], row["n_real"], row["caught"], row["n_false"]) == (kept, len(real), caught, len(false))
            points.append((round((1 - kept / len(real) if real else 0) + (1 - caught / len(false) if false else 0), 9), k / 100, kept, caught))
        flat = len({p[2:] for p in points}) == 1
        assert {t for (m, t), r in got.items() if m == method and r["chosen"]} == (set() if flat else {min(points)[1]})
    assert any(r["chosen"] for r in got.values())


@given(st.text("abcd", min_size=1, max_size=12), st.text("abcd ", max_size=80), st.sampled_from([0.0, 0.5, 0.9]))
def test_best_ratio_is_that_of_all_windows(needle, text, least):
    best = plain_ratio(needle, text)
    assert spans.best_ratio(needle, text, least) == (best if best >= least else 0.0)


def test_normal_form_in_the_jvm_is_that_of_the_map(spark):
    mapped = {r["id"]: r["text"] for r in offsets.normalise_with_map(fixtures.texts(spark).withColumnRenamed("fx_id", "id")).collect()}
    assert {r["fx_id"]: r["t"] for r in fixtures.texts(spark).select("fx_id", T.normalised(F.col("text")).alias("t")).collect()} == mapped
    for i, raw in fixtures.TEXTS:
        assert mapped[i] == plain_form(raw)[0]
