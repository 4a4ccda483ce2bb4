"""Texts with very many matches, and notices as they are published."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from proofmill.llm import licenses, secrets, substrings


def plain_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m.group(2)) >= secrets.ASSIGN_LEAST]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(secrets.ACCESS, text)]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(secrets.HEX, text)]
    return sorted(found)


def test_places_are_those_of_plain_search(spark):
    r = random.Random(8)
    parts = ["password = hunter2x", "token:ab", 'API_KEY="x/y+z=123"', "AKIA" + "A1" * 9, "0a1b2c3d" * 4, "zä😀", " ", "\n", "secret : ", "é" * 3, "", "passwd=" + "f" * 30]
    texts = ["".join(r.choice(parts) for _ in range(n)) for n in (0, 1, 2, 3, 7, 30, 200, 1000)] + [None, "no match", "token=abcdefg"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x["base"] for x in secrets.scan(frame).collect()}
    for i, text in enumerate(texts):
        assert [tuple(s) for s in got[i]] == plain_spans(text or ""), i


def test_running_sums_of_any_size(spark):
    for n in (1, 2, 3, 8, 9, 10, 99, 1000):
        values = [(k * 7919) % 13 for k in range(n)]
        column = F.array(*map(F.lit, values)).cast("array<bigint>") if n < 200 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k.cast("bigint") * 7919) % 13)
        got = spark.range(1).select(secrets.running(column, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("s")).first()["s"]
        assert got == [sum(values[:k]) for k in range(n)]


def test_many_matches_in_one_text_take_seconds(spark):
    """A text of 3 MB: time grows about with the text, not with its square."""
    line = "password=hunter{:06d}x and some words AKIA{:016d} here\n"
    seconds = {}
    for n in (12_000, 48_000):
        text = "".join(line.format(i % 10**6, i) for i in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.perf_counter()
        row = secrets.find_secrets(frame).first()
        seconds[n] = time.perf_counter() - began
        assert (row["n_assign"], row["n_access"]) == (n, n)
        began = time.perf_counter()
        out = secrets.scan(frame, keep=("text",)).select(secrets.redacted(F.col("text"), F.col("spans")).alias("o")).first()["o"]
        seconds[-n] = time.perf_counter() - began
        assert out.count("[secret]") == 2 * n and "hunter" not in out
    assert seconds[48_000] < 60 and seconds[-48_000] < 60, seconds


def test_redaction_of_overlapping_spans(spark):
    r = random.Random(2)
    span = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
    for n in (0, 1, 5, 40, 300):
        text = "".join(r.choice("abcdé😀 \n") for _ in range(4 * n + 9))
        spans = sorted((a, 0, "x", a + r.randrange(1, 6)) for a in (r.randrange(len(text) - 5) for _ in range(n)))
        out, at = [], 0
        for a, _, _, b in spans:
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        got = spark.createDataFrame([(text, spans)], f"text string, spans {span}").select(secrets.redacted(F.col("text"), F.col("spans")).alias("o")).first()["o"]
        assert got == "".join(out) + text[at:]


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_notices_with_blank_lines_inside(spark):
    """The published layout, with its name and six words of its opening changed, so that only the whole notice can be found."""
    changed = MIT.replace("MIT License", "Terms").replace("Permission is hereby granted, free of charge,", "Consent was given here, at no cost,")
    texts = [(1, changed), (2, changed.replace("\n\n", "\n")), (3, "words " * 400 + changed + "words " * 400), (4, "\n\n".join(changed.split("\n"))), (5, "\n\n".join(changed.split()[::3]))]
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert all(got[i][0] == "mit" and 0.9 <= got[i][1] < 1 for i in (1, 2, 3, 4)) and got[5] == ("", 0.0)


def test_repeats_in_texts_without_a_place_among_documents(spark):
    """A null id, and an id with two texts: each row loses the repeats inside its own text, and nothing else."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    passage = [word() for _ in range(30)]
    inside = [word() for _ in range(9)] + passage + ["x"] + passage + [word()]
    texts = [(None, inside), (None, passage), (1, inside), (1, ["spin"] * 60), (2, passage), (3, passage + ["end"]), (None, inside), (None, [])]
    got = sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.remove_repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id bigint, text string")).collect()), key=repr)
    want = []
    for i, w in texts:
        seen, gone = set(), set()
        for at in range(len(w) - 19):
            window = tuple(w[at : at + 20])
            gone |= set(range(at, at + 20)) if window in seen else set()
            seen.add(window)
        gone = set(range(30)) if i == 3 else gone
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == sorted(want, key=repr) and [g for g in got if g[2] == 30]
