"""Importance resampling, perplexity bands and token alignment against plain computations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.llm import alignment, importance, perplexity

R = random.Random(3)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 6))) for _ in range(80)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


LONG = " ".join(words(30_000, 1))
TEXTS = [
    (1, "The team, the TEAM and ÉCOLE école x1", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, LONG, "en"), (1, "The team, the TEAM and ÉCOLE école x1", "en"),
    (6, " ".join(words(40, 2)), "fr"), (None, " ".join(words(30, 3)), "fr"), (7, " ".join(words(25, 4) * 3), "fr"), (8, "日本語 テスト ­ 1234 " * 6, None),
    (9, "\n".join([" ".join(words(6, 5))] * 5), "en"), (10, "<|endoftext|> <s> </s> ▁ x", "en"), (11, "a" * 3000 + " " + "=" * 70, "de"), (None, None, None),
] + [(20 + i, " ".join(words(30 + i, 50 + i)), "en" if i % 3 else "fr") for i in range(40)]
CLASHING = ("row", "word", "at", "bucket", "gain", "weight", "score", "rank", "level", "its", "salt", "least", "most", "pack", "groups", "group", "step", "n", "code", "w1", "place", "range", "of")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string").repartition(3)
    path = str(tmp_path_factory.mktemp("docs") / "d")
    frame.withColumns({c: F.lit("clash") for c in CLASHING}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("doc_id < -5")


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# -- 11


def split(text):
    lower = "".join(c.lower() if c in importance.UPPER else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 3)])
def test_importance_draw(spark, docs, orders):
    target = [(" ".join(words(50, 2)),), (None,), ("",), ("the team",)]
    buckets, percent, least, seed = 97, 30, 20, 5
    runs = lambda text: [" ".join(w[i : i + n]) for w in [split(text)] for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in runs(text)) for texts in ([d[1] for d in TEXTS], [x[0] for x in target]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)}
    scored = []
    for i, text, _ in TEXTS:
        found = runs(text)
        weight = sum(gain[bucket(x)] for x in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(text))))
    able = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = len(able) * percent // 100
    want = [(*x[:4], n if n <= drawn else None) for n, x in enumerate(able, 1)] + [(*x[:4], None) for x in scored if x[4] < least]
    out = importance.importance_draw(docs, spark.createDataFrame(target, "text string"), orders, buckets, percent, least, seed)
    assert plain(out) == sorted(want, key=repr) and drawn > 5


def test_importance_of_empty_tables(spark, docs, no_docs):
    target = spark.createDataFrame([("the",)], "text string")
    assert importance.importance_draw(no_docs, target).count() == 0
    rows = importance.importance_draw(docs, target.where("false")).collect()
    assert len(rows) == len(TEXTS) and {r["n_features"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}


def test_ranks_of_ties(spark):
    frame = spark.createDataFrame([(i % 40 if i % 7 else None, i % 3) for i in range(200)], "doc_id bigint, score bigint").repartition(5)
    got = importance.ranked(frame).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 201))
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order)


def test_a_window_looks_ahead_only_for_longer_runs(spark, docs):
    plan = lambda orders: importance.features(importance.positions(docs.select(F.monotonically_increasing_id().alias("row"), "text"), ["row"]), ["row"], orders)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan((1, 2)) and "lead(word" in plan((1, 2)) and "Exchange" not in plan((1, 1))


# -- 12


def symbols(text):
    return [int(perplexity._SYMBOL[b]) for b in text.encode()]


def plain_model(texts, order):
    """Modified Kneser-Ney in exact fractions of counts, by dictionaries."""
    pad = [perplexity.LINE] * (order - 1)
    top = Counter(tuple(s[i : i + order]) for t in texts for s in [pad + symbols(t)] for i in range(len(s) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    take = {}
    for k, counts in levels.items():
        n = Counter(counts.values())
        take[k] = (0, *map(Fraction, perplexity.PLAIN_DISCOUNTS))
        if all(n[i] for i in (1, 2, 3, 4)):
            y = Fraction(n[1], n[1] + 2 * n[2])
            own = (0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
            take[k] = own if all(0 < d <= i for i, d in enumerate(own) if i) else take[k]
    after = {k: defaultdict(list) for k in levels}
    for k, counts in levels.items():
        for g, c in counts.items():
            after[k][g[:-1]].append(c)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / perplexity.SYMBOLS
        seen = after[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        c = levels[k].get(gram, 0)
        return float((c - take[k][min(c, 3)]) / sum(seen)) + float(sum(take[k][min(x, 3)] for x in seen) / sum(seen)) * p(gram[1:])

    return p


def test_probabilities_are_those_of_kneser_ney(spark):
    texts = [" ".join(words(60, 9)), "Ab 1. x", "\n\néé!", "", "aaaa aaaa", " ".join(words(30, 10))]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    model, p = perplexity.train(frame), plain_model(texts, perplexity.ORDER)
    pad = [perplexity.LINE] * (perplexity.ORDER - 1)
    for text in [*texts, "zq zq 99 ##", "never seen Before, 12"]:
        codes, bounds = perplexity.runs_of([text.encode()])
        got = perplexity.log_probability(model, codes)
        s = pad + symbols(text)
        want = [math.log(p(tuple(s[i : i + perplexity.ORDER]))) for i in range(len(symbols(text)))]
        assert np.allclose(got, want, atol=1e-9) and bounds.tolist() == [0, len(want)]
    history = tuple(symbols("ab "))
    every = np.array([sum(x * perplexity.SYMBOLS ** (3 - i) for i, x in enumerate((*history, last))) for last in range(perplexity.SYMBOLS)])
    assert abs(np.exp(perplexity.log_probability(model, every)).sum() - 1) < 1e-9
    for hashes in model.hashes:
        assert (np.diff(hashes.astype(object)) > 0).all()
    assert perplexity.train(frame.where("text is null")) is None and len(model.hashes[-1]) <= perplexity.SYMBOLS**perplexity.ORDER


def test_counts_and_verdicts(spark, docs, no_docs):
    got = [r.asDict() for r in perplexity.judge(docs).collect()]
    assert len(got) == len(TEXTS) and perplexity.judge(no_docs).count() == 0
    p = plain_model([t or "" for _, t, _ in TEXTS if t != LONG] + [LONG], perplexity.ORDER)
    pad, cache, rows = [perplexity.LINE] * (perplexity.ORDER - 1), {}, []
    for i, text, lang in TEXTS:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + d for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for d in range(8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        s, total = pad + symbols(text), 0.0
        for k in range(len(s) - 3):
            g = tuple(s[k : k + 4])
            if g not in cache:
                cache[g] = math.log(p(g))
            total += cache[g]
        level = -total / len(symbols(text)) if text else None
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        rows.append((i, lang, (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed), level))
    band = {}
    for lang in {r[1] for r in rows}:
        steps = sorted(round(r[3] * perplexity.GRID) for r in rows if r[1] == lang and not r[2][5] and r[3] is not None)
        at = lambda q: steps[-(-q * len(steps) // 100) - 1] if steps else None  # noqa: B023, E731
        if steps:
            middle = at(50)
            band[lang] = tuple((middle + perplexity.STRETCH * (at(q) - middle)) / perplexity.GRID for q in perplexity.OUTER)
    want = sorted(((i, *counts, bool(not counts[5] and level is not None and band[lang][0] <= level <= band[lang][1]), None if level is None else round(math.exp(level), 6)) for i, lang, counts, level in rows), key=repr)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(((*(r[c] for c in names), None if r["perplexity"] is None else round(r["perplexity"], 6)) for r in got), key=repr) == want
    assert any(r["kept"] for r in got) and any(r["base_failed"] for r in got)


def test_bands_reject_what_is_unlike_its_language(spark):
    clean = [(i, " ".join(words(60, 100 + i)), "en") for i in range(80)]
    odd = [(100, "QZX %% " * 40, "en"), (101, " ".join(f"{w}{w}" for w in "xyz" * 20), "en"), (102, "%7$ " * 60, "fr")]
    judged = {r["doc_id"]: r for r in perplexity.judge(spark.createDataFrame(clean + [(i, " ".join(a + str(k % 7) for k, a in enumerate(t.split())), lang) for i, t, lang in odd], "doc_id bigint, text string, lang string")).collect()}
    assert sum(judged[i]["kept"] for i in range(80)) >= 78
    assert not judged[100]["kept"]


# -- 13


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers

    return tuple(open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_tokens(tools, text):
    """Ids and bytes of each token of both, or nothing."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return [], []
    a, b = Tokenizer.from_str(tools[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=tools[1])
    a.encode_special_tokens = True
    codes = {}
    extra = 256
    for byte in range(256):
        if not (33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte):
            codes[chr(extra)] = byte
            extra += 1
        else:
            codes[chr(byte)] = byte
    left = [(i, bytes(codes[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def ends(tokens):
    at, out = 0, []
    for i, x in tokens:
        at += len(x)
        out.append((i, at))
    return out


def plain_groups(left, right):
    a, b = ends(left), ends(right)
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    of = lambda tokens: {k: [i for i, _ in g] for k, g in groupby(tokens, key=lambda x: next(c for c in cuts if x[1] <= c))}
    x, y = of(a), of(b)
    return [(x[c], y[c]) for c in cuts]


ALIGNED = [t for t in TEXTS if t[1] != LONG] + [(70, "don't   stop\n\nnow 😀👩‍👩‍👧 naïve Übergröße 12345.678", "en"), (71, "unrelated the the unrelatedthe", "en"), (72, "ab\x00cd\r\nef", "en"), (73, " lead", "en"), (74, "   ", "en")]


@pytest.mark.parametrize("size", [1 << 21, 400])
def test_alignment(spark, tools, monkeypatch, size):
    monkeypatch.setattr(alignment, "PACK_BYTES", size)
    found = {text: plain_groups(*plain_tokens(tools, text)) for text in {t for _, t, _ in ALIGNED}}
    linked = Counter(pair for _, text, _ in ALIGNED for pair in {(a, b) for xs, ys in found[text] for a in xs for b in ys})
    most = {}
    for (a, _), n in linked.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for i, text, _ in ALIGNED:
        groups = found[text]
        links = [(a, b) for xs, ys in groups for a in xs for b in ys]
        line = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        want.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(linked[p] == most[p[0]] for p in links), sum(linked[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    frame = spark.createDataFrame(ALIGNED, "doc_id bigint, text string, lang string").repartition(2).withColumns({c: F.lit(1) for c in CLASHING})
    assert plain(alignment.align_tokens(frame, *tools)) == sorted(want, key=repr)
    assert any(len(x) > 1 and len(y) > 1 for g in found.values() for x, y in g) and found["<|endoftext|> <s> </s> ▁ x"] == []


def test_alignment_of_long_and_empty_tables(spark, tools, docs, no_docs):
    assert alignment.align_tokens(no_docs, *tools).count() == 0
    nothing = alignment.align_tokens(docs.where("text is null"), *tools).collect()
    assert {(r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in nothing} == {(0, 0, 0, "")} and len(nothing) == 2
    long = alignment.align_tokens(docs.where("doc_id = 5"), *tools).first()
    assert long["n_groups"] > 30_000 and long["n_best"] <= long["n_links"] == long["count_sum"]


def test_groups_of_equal_digest_are_compared(monkeypatch):
    monkeypatch.setattr(alignment, "_digests", lambda ids, starts: np.zeros(len(starts) - 1, dtype=np.uint64))
    g = alignment.grouped([np.array([1, 2])], [np.array([3, 4])], np.ones(5, dtype=np.int64), np.ones(5, dtype=np.int64))
    with pytest.raises(ValueError, match="digest"):
        alignment.interned(g)
