import re

from epochfold.llm import licenses as L

UP = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(text):
    w = words(text)
    places, own = [], set()
    for p, label in L.PHRASES:
        q = p.split()
        got = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        places += got
        own |= {label} if got else set()
    labels, best = set(own), 0.0
    own_lines = (text or "").split("\n")
    for line in [*own_lines, *[f"{a}\n{b}" for a, b in zip(own_lines, own_lines[1:])]]:
        b = set(words(line))
        for label, t in L.TEMPLATES:
            s = set(words(t))
            if len(b & s) >= L.CONTAINMENT * len(s) - 1e-9:
                labels.add(label)
                best = max(best, len(b & s) / len(s))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if own else best


TEXTS = [
    None, "", " ", "...", "Released under the MIT License.", "under the mit  license under-the_mit license", "cc by nc cc by nc",
    "CC BY-NC 4.0", "apache license, version 2", "apache license version 20", "éunder the mit license", "x\nThis work is licensed under the GNU General Public License, version 3.\ny",
    "this WORK is general public gnu version 3 the under licensed", "the the the of of and to a", "word " * 40_000 + "under the mit license", "under the mit license" * 2, "İ ſ K under the mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted\n# provided",
    "x\nlicensed under a creative commons\nattribution 4.0 international license\ny", "licensed under\nthe\napache license version 2.0", "all rights reserved no part may be reproduced",
]


def test_against_brute_force(spark):
    rows = [(i, t, "own", "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "own", "x"), (None, TEXTS[6], None, None)]
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, _text string")).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=repr)


def test_wrapped_lines_are_one_block(spark):
    df = spark.createDataFrame([(1, "a\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted\nb"), (2, "released under the mit license\nwith thanks")], "doc_id long, text string")
    out = {r.doc_id: [(b.line, b.n_lines, b.label) for b in r.blocks] for r in L.scan(df).collect()}
    assert out == {1: [(1, 2, "bsd")], 2: [(0, 1, "mit")]}


def test_low_threshold_and_empty_table(spark):
    df = spark.createDataFrame([(1, "under mit the released x"), (2, "granted free")], "doc_id long, text string")
    out = {r.doc_id: r.labels for r in L.scan(df, share=0.75).collect()}
    assert out == {1: "mit", 2: ""}
    assert L.scan(df.limit(0)).count() == 0
