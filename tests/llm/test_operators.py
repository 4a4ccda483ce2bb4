"""Each operator against a plain computation, on rows with nulls, blanks, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proofmill.llm import chat, components, decontaminate, jaccard, licenses, mixing, quality, secrets, substrings, tokens, vectors

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghijk") for _ in range(random.randint(2, 7))) for _ in range(300)]


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def near(text: list[str], every: int) -> list[str]:
    return [w if i % every else w + "x" for i, w in enumerate(text, 1)]


BASE, LONG = words(200, 1), words(30_000, 2)
TEXTS = [
    (0, " ".join(BASE), "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, " ".join(BASE), "a"), (5, "\n".join(BASE).title(), "b"),
    (6, " ".join(near(BASE, 190)), "b"), (7, " ".join(near(BASE, 20)), "c"), (8, "one two", None), (9, "One  two", None), (10, " ".join(LONG), "c"),
    (11, " ".join(words(60, 5) + BASE[40:90] + words(50, 6)), "c"), (12, "spin " * 120, "a"), (13, "éàü " * 30 + "　x", "a"), (14, "Released under the MIT License.\nx", "d"),
    (15, "a GNU General Public\nLicense, MIT license", "d"), (0, " ".join(BASE), "a"), (16, " ".join(near(near(BASE, 190), 170)), "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id bigint, text string, source string").repartition(3)
    clashing = ("id", "key", "h", "n", "rep", "hash", "size", "words", "label", "content", "digest", "part", "start", "a", "b")
    return frame.withColumns({c: F.lit("clash") for c in clashing})


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("doc_id < -5")


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def reachable(ids, links):
    low = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a, b in links:
            m = min(low[a], low[b])
            again |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


# -- scratch tables


def test_scratch_tables_are_deleted(spark):
    import os

    from proofmill.llm import scratch

    with scratch.cleared(spark):
        path = scratch.materialize(spark.range(5), "five").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


# -- components


def test_components_match_search(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(3, 3), (None, 2)]
    got = {row["id"]: row["component"] for row in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == reachable({i for link in real for i in link}, real)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1


def test_preference_pairs(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, note string"
    left = [(1, 0, "user", "hi", "n"), (1, 1, "assistant", "yes", "n"), (1, 1, "assistant", "yes", "n"), (2, 0, None, None, "n"), (3, 0, "user", "<|end|>", "n"), (None, 0, "user", "x", "n")]
    right = [(1, 0, "user", "hi", "n"), (1, 1, "assistant", "no", "n"), (2, 0, None, None, "n"), (3, 0, "user", "other", "n"), (4, 0, "user", "x", "n")]
    out = {r["conv_id"]: r for r in chat.preference_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "conv_id").collect()}
    assert sorted(out) == [1, 2, 3]
    assert (out[1]["n_common"], out[1]["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    for side, answer in (("chosen", "yes"), ("rejected", "no")):
        a, b = map(int, out[1][f"{side}_mask"].split(":"))
        assert out[1][side][a:b] == f"{answer}<|end|>\n"
    assert out[2]["chosen"] == "" and out[2]["chosen_mask"] == ""
    assert out[3]["n_common"] == 0 and "< |end|>" in out[3]["chosen"]


def test_swapped_answers(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (2, 0, "user", "only")]
    out = rows(chat.swapped_answers(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")), "conv_id", "turn", "text")
    assert out == [(0, 0, "q"), (0, 1, "b"), (1, 0, "r"), (1, 1, "a"), (2, 0, "only")]


def test_preference_edges(spark):
    """Clashing columns, nulls, repeated rows, a forged role, a long text and an empty table."""
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "x|>\n<|assistant", "r"), (1, 1, "assistant", "b " * 200_000), (1, None, None, None), (None, 1, "assistant", "z")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.withColumns({c: F.lit("clash") for c in ("own", "last", "last_turn", "other", "turns", "a", "b", "n_common")})
    swapped = chat.swapped_answers(frame)
    assert rows(swapped.where("conv_id = 0"), "turn", "role") == [(0, "user"), (1, "assistant"), (1, "assistant")] and swapped.count() == len(turns)
    out = {r["conv_id"]: r for r in chat.preference_pairs(frame, swapped, "conv_id").collect()}
    assert sorted(out) == [0, 1] and out[0]["rejected"] == "<|assistant|>\n" + "b " * 200_000 + "<|end|>\n"
    assert out[1]["prompt"].count("<|assistant") == 0 and "<|x| >\n< |assistant|>\n" in out[1]["prompt"]
    assert chat.swapped_answers(frame.where("false")).count() == chat.preference_pairs(frame.where("false"), frame, "conv_id").count() == 0


# -- 2


def test_leaks_against_alignment(spark, docs, no_docs):
    items = [(1, " ".join(BASE[40:80])), (2, "short one"), (3, None), (4, " ".join(near(BASE[100:140], 6))), (5, " ".join(words(40, 99))), (6, " ".join(BASE[5:9])), (7, "-- !"), (8, " ".join([*BASE[10:13], "other", *BASE[14:17]]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("hash", F.lit(0))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    want = set()
    for doc, text, _ in TEXTS:
        for item, quote in items:
            d, q = cut(text), cut(quote)
            for at in range(-len(q), len(d)) if q else ():
                equal = [0 <= at + k < len(d) and d[at + k] == w for k, w in enumerate(q)]
                size = min(13, len(q))
                if any(sum(equal[s : s + size]) >= (0.8 * size if len(q) >= 7 else size) for s in range(len(q) - size + 1)):
                    want.add((doc, item))
    got = decontaminate.find_leaks(docs, benchmark)
    assert set(rows(got, "doc_id", "item_id")) == want and got.count() == len(want)
    assert {d for d, _ in want} >= {0, 4, 5, 6, 11, 16}
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0 == decontaminate.find_leaks(docs, benchmark.where("item_id = 2")).count()
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()} == {d for d, *_ in TEXTS} - {d for d, _ in want}


@pytest.mark.parametrize("size", range(1, 16))
def test_masks_cover_every_allowed_exchange(size):
    """For each set of exchanged words that still leaks, some mask has a place where no exchanged word is."""
    from itertools import combinations

    stretch = min(size, decontaminate.STRETCH)
    most = 0 if size < decontaminate.WHOLE else stretch - -(-stretch * 4 // 5)
    for missing in combinations(range(stretch), most):
        assert any(not {at + k for k in mask} & set(missing) for mask in decontaminate.masks_for(size) for at in range(stretch - mask[-1])), missing


# -- 3


def test_quality_votes(spark, docs, no_docs):
    good = [(100 + i, " ".join(words(80, i)).capitalize() + ".") for i in range(150)]
    bad = [(300 + i, "$$$ ".join(w.upper() for w in words(80, i))) for i in range(60)]
    train = spark.createDataFrame([*good, *bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in good + bad] + [(None, 1, 0), (100, None, 0), (101, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = quality.score_quality(train, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 210 and len(held) > 20
    assert sum(r["predicted"] == int(r["doc_id"] < 300) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    edge = quality.scorer(train, labels, bound=120)
    scored = docs.select("doc_id", edge(F.col("text")).alias("score")).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    by_id = defaultdict(set)
    for r in scored:
        by_id[r["doc_id"]].add(round(r["score"], 12))
    assert by_id[1] == by_id[2] and len(by_id[0]) == 1
    assert quality.score_quality(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(train, labels.where("quality > 5")).collect()} == {0.5}


def test_quality_scores_are_plain_votes_of_cosines(spark):
    """Scores recomputed one by one: plain counts, cosine with every labelled vector, the nearest weighted by similarity."""
    import math

    import numpy as np

    texts = [(i, " ".join(words(60, i)) + (" zz zz zz !!" * 9 if i % 4 == 0 else ".")) for i in range(80)] + [(80, None), (81, ""), (82, "ab")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id bigint, quality int")
    model = quality.train(frame, labels)
    scored = {r["doc_id"]: (r["score"], r["held_out"]) for r in quality.score_quality(frame, labels).collect()}
    assert len(model.labels) == sum(not scored[i][1] for i in range(80))
    for i, text in texts:
        counts = quality.counts_of(text or "")
        w = (text or "").split()
        assert counts[-2] == sum(a == b for a, b in zip(w, w[1:])) and counts[:-2].sum() == 2 * max(len((text or "").encode()) - 2, 0)
        vector = quality.embed(model, counts[None, :])[0]
        near = sorted(((sum(float(a) * float(b) for a, b in zip(vector, v)), label) for v, label in zip(model.vectors, model.labels)), reverse=True)
        assert all(abs(math.sqrt(float(v @ v)) - 1) < 1e-3 for v in model.vectors)
        top = [(max(c, 1e-6) ** quality.SHARPNESS, label) for c, label in near[: quality.NEIGHBOURS]]
        tied = near[quality.NEIGHBOURS - 1][0] - near[quality.NEIGHBOURS][0] < 1e-5
        assert tied or abs(scored[i][0] - sum(c * label for c, label in top) / sum(c for c, _ in top)) < 1e-4
    again = quality.train(frame.unionAll(frame).unionAll(spark.createDataFrame([(1, "other text")], frame.schema)), labels)
    assert np.array_equal(again.labels, model.labels)


# -- 4


def test_token_counts_and_cache(docs, no_docs, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    data, library = open(path, "rb").read(), Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((d, len((t or "").encode()), count(t), count(t) > 512) for d, t, _ in TEXTS), key=repr)
    cache = str(tmp_path / "cache")
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows(tokens.count_tokens(docs.where("doc_id < 8"), data, cache_path=cache), *columns) == [w for w in want if w[0] < 8]
    before = docs.sparkSession.read.parquet(cache).count()
    assert rows(tokens.count_tokens(docs, data, cache_path=cache), *columns) == want
    after = docs.sparkSession.read.parquet(cache)
    assert before < after.count() == after.select("content").distinct().count() == len({t or "" for _, t, _ in TEXTS})
    assert tokens.count_tokens(no_docs, data).count() == 0
    odd = docs.sparkSession.createDataFrame([(None, "x <|endoftext|> y"), (None, None), (1, "x")], "doc_id bigint, text string")
    assert rows(tokens.count_tokens(odd, data), "n_tokens") == sorted((count(t),) for t in ("x <|endoftext|> y", "", "x"))


def test_piece_tokenizer(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows(tokens.count_tokens(docs.where("doc_id <> 10"), open(path, "rb").read(), "model"), "doc_id", "n_tokens")
    assert got == sorted(((d, len(model.encode(t or ""))) for d, t, _ in TEXTS if d != 10), key=repr)


# -- 5

SECRETS = [
    (1, "password=12345 Secret: 'abcdefg' TOKEN==abc api_key = \"x-y_z.9\""), (2, "😀 AKIA" + "A1" * 8 + " and AKIASHORT"), (3, "0" * 24 + "f" + " é " + "ab" * 11),
    (4, None), (5, ""), (6, "token:token:abcdef12 passwd=a=b=c=d"), (7, "secret: " + "deadbeef" * 5 + ", x"), (7, "secret: " + "deadbeef" * 5 + ", x"),
]


def base_of(text):
    found = []
    for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A):
        found += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 6)
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(spark, docs, no_docs):
    r = random.Random(3)
    letters = secrets.ALPHABETS["base64"][:64]
    planted = [(50 + i, f"see {''.join(r.choice(letters) for _ in range(64))} end") for i in range(30)]
    frame = spark.createDataFrame([*SECRETS, *planted], "doc_id bigint, text string").withColumn("base", F.lit(1))
    out = secrets.find_secrets(frame).collect()
    assert len(out) == len(SECRETS) + len(planted)
    for row in out:
        text = dict([*SECRETS, *planted])[row["doc_id"]]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base_of(text))
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in row["spans"].split(",") if s and not s.startswith("random")] == [s for s in base.split(",") if s]
        assert row["n_hex"] == sum(k == "hex" for *_, k, _ in base_of(text))
    found = [row for row in out if row["doc_id"] >= 50 and "random:4:68" in row["spans"]]
    assert len(found) >= 25
    assert all(row["spans"] == "" for row in secrets.find_secrets(docs).collect())
    assert secrets.find_secrets(no_docs).count() == 0


@pytest.mark.parametrize(("size", "recall"), [(20, 0.5), (24, 0.7), (32, 0.85), (40, 0.88)])
def test_short_random_tokens_among_ordinary_ones(spark, size, recall):
    r = random.Random(size)
    letters = secrets.ALPHABETS["base64"][:64]
    parts = "get set user name file path test value index config parse header buffer stream node list table result count error".split()
    keys = ["".join(r.choice(letters) for _ in range(size)) for _ in range(400)]
    names = ["_".join(r.choice(parts) for _ in range(12))[:size] for _ in range(400)]
    out = secrets.find_secrets(spark.createDataFrame([(i, f"see {t} end") for i, t in enumerate(keys + names)], "doc_id bigint, text string")).collect()
    found = [row["doc_id"] for row in out if f"random:4:{4 + size}" in row["spans"]]
    right = sum(i < len(keys) for i in found)
    assert right >= recall * len(keys)
    assert len(found) - right <= 0.1 * len(found)


def plain_step(token):
    """Length class and step of a token by plain sums: three tests, one weighted sum of normal scores, an exact tail."""
    import math
    from statistics import NormalDist

    letters = next((a for a in secrets.ALPHABETS.values() if not set(token) - set(a)), None)
    name = next(k for k, a in secrets.ALPHABETS.items() if a == letters)
    n, k, v = len(token), len(letters), [letters.index(c) for c in token]
    cls = sum(n >= at for at in secrets.LENGTHS)
    uneven, spread = secrets.ORDINARY[name][cls]
    chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in letters)
    even = (k - 1 + n * uneven - chi) / (spread * math.sqrt(2 * (k - 1) + 4 * n * uneven))
    high = [2 * x >= k for x in v]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    m = sum(v) / n
    about = sum((x - m) ** 2 for x in v)
    serial = sum((a - m) * (b - m) for a, b in zip(v, v[1:] + v[:1])) / about if about else 1.0
    p_serial = math.erfc(abs(serial + 1 / (n - 1)) * math.sqrt(n / 2))
    if min(p_runs, p_serial) < secrets.REJECT:
        return cls, 0.0
    score = lambda p: NormalDist().inv_cdf(min(max(p, 1e-6), 1 - 1e-6))
    w = secrets.WEIGHTS
    z = (w[0] * even + w[1] * score(p_runs) + w[2] * score(p_serial)) / math.sqrt(sum(x * x for x in w))
    return cls, -secrets.STEPS * math.log10(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-20))


def test_battery_and_control_against_plain_sums(spark):
    r = random.Random(17)
    tokens_ = ["".join(r.choice(a) for _ in range(n)) for a in secrets.ALPHABETS.values() for n in (20, 23, 31, 48, 90, 200)]
    tokens_ += [t[: len(t) // 2] + "a" * (len(t) - len(t) // 2) for t in tokens_[:20]] + ["0123456789" * 3, "abcdefgh" * 4, "user_name_of_the_file_path_index", "z" * 40]
    frame = spark.createDataFrame([(i, f"see {t} end") for i, t in enumerate(tokens_)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["t"]["length_class"], r["t"]["step"]) for r in frame.select("doc_id", secrets.tested(secrets.placed(F.col("text"), secrets.TOKEN))[0].alias("t")).collect()}
    for i, token in enumerate(tokens_):
        cls, step = plain_step(token)
        assert got[i][0] == cls and abs(got[i][1] - max(0, min(int(step), secrets.MOST_STEPS))) <= max(1, 0.02 * step), (token, got[i], step)
    # Benjamini-Hochberg by class: the most tokens whose largest p is within their share.
    least = secrets.least_steps(secrets.scan(frame).sparkSession.createDataFrame([([dict(start=0, stop=1, length_class=c, step=s)],) for c, s in got.values()], "tokens array<struct<start:bigint,stop:bigint,length_class:int,step:int>>"))
    for cls in {c for c, _ in got.values()}:
        steps = sorted((s for c, s in got.values() if c == cls), reverse=True)
        passing = [k for k in range(1, len(steps) + 1) if 10 ** (-steps[k - 1] / secrets.STEPS) <= secrets.FALSE_SHARE * k / len(steps)]
        assert least.get(cls) == (steps[max(passing) - 1] if passing else None)


def test_redaction(spark):
    frame = spark.createDataFrame(SECRETS, "doc_id bigint, text string")
    scanned = secrets.scan(frame, keep=("doc_id", "text"))
    for row in scanned.select("text", secrets.redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("out"), "spans").collect():
        text, want, at = row["text"] or "", "", 0
        for a, _, _, b in row["spans"]:
            want += text[at:a] + "[secret]" if a >= at else ""
            at = max(at, b)
        assert row["out"] == want + text[at:]


# -- 6


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def license_rows(texts):
    cut = lambda t: [w.translate(str.maketrans(licenses.UPPER, licenses.LOWER)) for w in re.findall(WORD, t)]
    want = []
    for doc, text in texts:
        w, places, labels, share = cut(text or ""), [], set(), 0.0
        for label, phrase in licenses.PHRASES:
            here = [i for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
            places += here
            labels |= {label} if here else set()
        base = ",".join(sorted(labels))
        for reach, templates in zip(licenses.REACH, licenses.CLASSES):
            for at in range(0, max(len(w) - reach, 1), reach):
                for label, template in templates:
                    t = set(template.split())
                    found = len(t & set(w[at : at + 2 * reach])) / len(t)
                    if found >= licenses.CONTAINED:
                        labels, share = labels | {label}, max(share, found)
        ends = (min(places), max(places)) if places else (None, None)
        want.append((doc, len(w), len(places), *ends, base, ",".join(sorted(labels)), 1.0 if places else share))
    return sorted(want, key=repr)


LICENSE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_license_places_and_templates(docs, no_docs):
    assert rows(licenses.scan_licenses(docs), *LICENSE_COLUMNS) == license_rows([(d, t) for d, t, _ in TEXTS])
    assert licenses.scan_licenses(no_docs).count() == 0


def test_license_notices_wrapped_over_lines(spark):
    import textwrap

    texts, want = [], {}
    for label, template in licenses.TEMPLATES + licenses.NOTICES:
        for before in range(0, 76, 15):
            for width, mark in ((72, ""), (72, " * "), (24, "# ")):
                filled = textwrap.wrap(("zz " * 30)[:before] + " " + template, width)
                want[len(texts)] = label
                texts.append((len(texts), "above\n\n" + "\n".join(mark + line for line in filled) + "\n\nbelow"))
    apart = len(texts)
    texts += [(apart, "permission is hereby granted free of charge\n\nto any person obtaining a copy of this software")]
    texts += [(apart + 1, "permission is hereby granted free of charge\n" + "zz\n" * 40 + "to any person obtaining a copy of this software")]
    frame = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in frame.collect()}
    assert [i for i, label in want.items() if label not in got[i]["labels"].split(",") or got[i]["score"] != 1.0] == []
    assert got[apart]["labels"] == "mit" and got[apart + 1]["labels"] == ""
    assert rows(frame, *LICENSE_COLUMNS) == license_rows(texts)


# -- 7


def targets_by_rounds(sizes: dict, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mix_targets_and_rounding(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = random.Random(8)
    many = [(i, "w " * r.randint(0, 40), r.choice(["p", "q", "r", None, "z"]) if i > 40 else "tiny") for i in range(600)]
    for frame, source in ((docs, TEXTS), (spark.createDataFrame(many, "doc_id bigint, text string, source string"), many)):
        out = mixing.mix_sources(frame).collect()
        again = mixing.mix_sources(frame.repartition(5)).collect()
        assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(source)
        sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
        for _, text, name in source:
            n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
            sizes[name] += n
            largest[name] = max(largest[name], n)
        want = targets_by_rounds(sizes)
        for row in out:
            taken[row["source"]] += row["taken"]
            assert row["source_size"] == sizes[row["source"]] and row["taken"] <= 3 * row["size"]
            assert row["target"] == pytest.approx(want[row["source"]])
        for name in sizes:
            assert abs(taken[name] - want[name]) <= largest[name] + 1e-6
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_rounds_copies_and_null_ids_apart(spark, monkeypatch):
    """Many equal rows get close to their expected copies together, and land in more than one group."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 50)
    rows_ = [(7, "a b c", "p")] * 400 + [(None, "a b", "p")] * 400 + [(1000 + i, "x " * (i % 9), "q") for i in range(300)]
    out = mixing.mix_sources(spark.createDataFrame(rows_, "doc_id bigint, text string, source string").repartition(6)).collect()
    assert len(out) == len(rows_)
    for key in (7, None):
        mine = [r for r in out if r["doc_id"] == key]
        each = mine[0]["target"] / mine[0]["source_size"]
        assert len(mine) == 400 and {r["copies"] for r in mine} <= {int(each), int(each) + 1}
        assert abs(sum(r["copies"] for r in mine) - 400 * each) < 0.15 * 400


def test_pivotal_round_keeps_words_and_expectation():
    r = random.Random(1)
    sizes, parts = [r.randint(1, 9) for _ in range(40)], [r.choice([0.25, 0.5, 0.9]) for _ in range(40)]
    means = [0.0] * 40
    for _ in range(4000):
        out, held = mixing.pivotal_round(sizes, parts, [r.random() for _ in sizes], last=False)
        assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(sum(s * p for s, p in zip(sizes, parts)))
        assert all(p in (0.0, 1.0) for i, p in enumerate(out) if i != held)
        means = [m + p / 4000 for m, p in zip(means, out)]
    assert all(abs(m - p) < 0.05 for m, p in zip(means, parts))


# -- 8


def test_vectors_against_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(5)
    base = r.standard_normal((40, 16))
    points = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(np.vstack([base, base[:20] + 0.04 * r.standard_normal((20, 16)), base[:5] * 3, base[:2]]))]
    points += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, points[0][1], None), (905, points[0][1][:8], 0), (None, points[0][1], 0), points[1]]
    frame = spark.createDataFrame(points, "vec_id bigint, embedding array<float>, label int").withColumns({"rep": F.lit(1), "h1": F.lit(2)})
    usable = [(i, np.array(v), label) for i, v, label in {p[0]: p for p in points}.values() if i is not None and i < 900]
    links = [(a, b) for a, x, m in usable for b, y, n in usable if a < b and m == n and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    low = reachable([i for i, *_ in points if i is not None], links)
    want = {i: (sum(i in link for link in links), low[i], low[i] == i) for i in low}
    for part in (vectors.CHUNK_ROWS, 4):
        vectors.CHUNK_ROWS, kept = part, vectors.CHUNK_ROWS
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(frame).collect()}
        vectors.CHUNK_ROWS = kept
        assert got.pop(None) == (0, None, True) and got == want
    assert vectors.near_vectors(frame.where("vec_id < -1")).count() == 0


def test_vectors_in_double_precision(spark):
    """Parts beyond single precision, large and small, count as they are."""
    large = [(0, [1e39, 2e39, 3e38]), (1, [1e39, 2.1e39, 2e38]), (2, [1e-60, 0.0, 0.0]), (3, [1.0, 1e-60, 0.0]), (4, [0.0, 1e-300, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in large], "vec_id bigint, embedding array<double>, label int")
    assert rows(vectors.near_vectors(frame), "vec_id", "n_links", "component_id") == [(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4)]


# -- 9


def test_repeats_against_windows(docs, no_docs):
    by_id = {d: (t or "").encode().split() for d, t, _ in TEXTS}
    seen, gone = set(), defaultdict(set)
    for doc in sorted(by_id):
        w = by_id[doc]
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[doc] |= set(range(i, i + 20))
            seen.add(window)
    want = sorted(((d, len(by_id[d]), len(gone[d]), hashlib.sha256(b" ".join(w for i, w in enumerate(by_id[d]) if i not in gone[d])).hexdigest()) for d, _, _ in TEXTS), key=repr)
    for limit in (substrings.GROUP_ROWS, 3):
        assert rows(substrings.remove_repeats(docs, group_rows=limit), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.remove_repeats(no_docs).count() == 0
    other = docs.sparkSession.createDataFrame([(4, "another text"), (None, " ".join(BASE))], "doc_id bigint, text string")
    got = rows(substrings.remove_repeats(docs.select("doc_id", "text").unionAll(other)), "doc_id", "n_words", "n_removed")
    assert {(4, 200, 0), (4, 2, 0), (None, 200, 0)} <= set(got) and len(got) == len(TEXTS) + 2


def test_maximal_repeats_against_all_places(spark):
    """Each repeat has the same words at both places and cannot be made longer there; all windows of repeats, and no others, are covered."""
    r = random.Random(9)
    passage = words(70, 30)
    texts = {i: words(r.randint(10, 60), 200 + i) + passage[r.randint(0, 20) : r.randint(45, 70)] + words(r.randint(0, 30), 300 + i) for i in range(12)}
    texts[20] = passage + words(15, 31) + passage
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string").repartition(3)
    for limit in (substrings.GROUP_ROWS, 3):
        found = substrings.find_repeats(frame, frame.select("doc_id"), limit).collect()
        covered = set()
        for x in found:
            a, b, k = texts[x["doc"]], texts[x["of_doc"]], x["length"]
            i, j = x["start"], x["of_start"]
            assert k >= 20 and (x["of_doc"], j) < (x["doc"], i) and a[i : i + k] == b[j : j + k]
            covered |= {(x["doc"], i + w) for w in range(k - 19)}
            if limit > 3:
                # The next word differs, or the longer window has its first occurrence elsewhere, where another repeat goes on.
                longer = (x["doc"], i + k - 19)
                assert i + k == len(a) or j + k == len(b) or a[i + k] != b[j + k] or any((y["doc"], y["start"]) == longer for y in found)
        seen, want = set(), set()
        for doc in sorted(texts):
            for at in range(len(texts[doc]) - 19):
                window = tuple(texts[doc][at : at + 20])
                want |= {(doc, at)} if window in seen else set()
                seen.add(window)
        assert covered == want and want


# -- 10


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def test_jaccard_against_all_pairs(docs, no_docs, monkeypatch):
    sets = {d: sets_of(t) for d, t, _ in TEXTS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = reachable(sets, links)
    want = sorted(((d, len(sets[d]), low[d]) for d, _, _ in TEXTS), key=repr)
    assert {low[d] for d in (0, 4, 5, 6, 16)} == {0} and low[7] == 7 and low[9] == 8
    for part, flush, common in ((jaccard.PART_ROWS, jaccard.FLUSH_CODES, jaccard.COMMON), (2, 150, 2)):
        monkeypatch.setattr(jaccard, "PART_ROWS", part)
        monkeypatch.setattr(jaccard, "FLUSH_CODES", flush)
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert rows(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_jaccard_of_copies_boilerplate_and_clashing_ids(spark, monkeypatch):
    """Long texts that are mostly the same passage, a group of copies of copies, and ids whose rows differ."""
    passage, r = words(400, 40), random.Random(41)
    texts = [(i, passage + words(r.randint(20, 150), 100 + i)) for i in range(25)]
    texts += [(100 + i, near(words(120, 50), r.randint(25, 90))) for i in range(30)]
    texts += [(200, words(90, 60)), (200, words(80, 61)), (201, near(words(90, 60), 80)), (202, near(words(80, 61), 75)), (203, words(90, 62)), (None, words(90, 62))]
    sets = defaultdict(list)
    for i, w in texts:
        if i is not None:
            sets[i].append(sets_of(" ".join(w)))
    links = [(a, b) for a in sets for b in sets if a < b and any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])]
    low = reachable(sets, links)
    assert {low[i] for i in (200, 201, 202)} == {200} and len({low[i] for i in range(25)}) > 5 and len({low[i] for i in range(100, 130)}) < 20
    want = sorted(((i, len(sets_of(" ".join(w))), low.get(i)) for i, w in texts), key=repr)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id bigint, text string").repartition(4)
    for part in (jaccard.PART_ROWS, 3):
        monkeypatch.setattr(jaccard, "PART_ROWS", part)
        assert rows(jaccard.jaccard_components(frame), "doc_id", "n_shingles", "component_id") == want


def test_tree_join_finds_all_pairs():
    import numpy as np

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 62, r.integers(5, 90)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate((s[: int(len(s) * 0.95)], r.integers(0, 1 << 62, 1).astype(np.uint64)))) for s in sets[:60]]
    n = np.array([len(s) for s in sets])
    left = np.array([len(s) - len(s) // 30 for s in sets])
    points = np.stack([jaccard.point_of(s) for s in sets])
    comp = np.arange(len(sets))
    comp[60:80] = 60
    a, b = jaccard.tree_pairs(n, left, points, comp)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            bound = jaccard.may_link(min(int(np.minimum(points[i], points[j]).sum()), left[i], left[j]), n[i], n[j])
            assert ((i, j) in got) == bool(bound and comp[i] != comp[j])


def test_very_long_sets_are_not_dropped():
    import numpy as np

    every = np.arange(5_200_000, dtype=np.uint64)
    sets = [every[:5_000_000], every[100_000:5_100_000], every[:2_000_000], every[:90]]
    n = np.array([len(s) for s in sets])
    points = np.stack([jaccard.point_of(s) for s in sets])
    for a, b in (jaccard.tree_pairs(n, n, points, np.arange(4)), jaccard.neighbours(n, n, points, np.arange(4))):
        assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == {frozenset((0, 1))}
