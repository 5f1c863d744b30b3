import numpy as np

from tidepool.llm import licences as L


def test_equals_scoring_line_by_line(spark, odd_documents, no_documents):
    lines = [t for group in L.TEMPLATES.values() for t in group] + L.UNKNOWN_EXAMPLES + L.NONE_EXAMPLES
    lines += ["Released under the MIT License.", "licensed", "CC BY-NC 4.0 or so", "", "The license of the software is unknown to me", "mit der und die", "released under the terms"]
    docs = spark.createDataFrame([(i, f"plain words\n{t}\r\nmore") for i, t in enumerate(lines)] + [(0, f"plain words\n{lines[0]}\r\nmore")], "doc_id long, text string")
    classes, weights, bias = L.fitted()
    want = []
    for i, t in enumerate(lines):
        words = L.words_of(t)
        known = [weights[g] for g in L.grams_of(words) if g in weights]
        if not known:
            continue
        z = bias + np.sum(known, axis=0)
        top = int(np.argmax(z))
        if classes[top] == "none":
            continue
        p = 1 / np.exp(z - z[top]).sum()
        mine = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
        share = max((len(mine & s) / len(s) for x in L.TEMPLATES.get(classes[top], []) for w in [L.words_of(x)] for s in [{tuple(w[j : j + 3]) for j in range(len(w) - 2)}] if s), default=0.0)
        want.append((i, 1, classes[top] if p >= L.LEAST_PROBABILITY and share >= L.CONFIRM else "unknown", round(float(p), 5), round(share, 6)))
    got = sorted((r.doc_id, r.line_no, r.family, round(r.probability, 5), r.overlap) for r in L.scanned(docs).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted([*want, want[0]])]
    assert all(abs(g[3] - w[3]) < 2e-5 and abs(g[4] - w[4]) < 1e-5 for g, w in zip(got, sorted([*want, want[0]]), strict=True))
    assert L.scanned(odd_documents).count() == 0 and L.scanned(no_documents).count() == 0


def test_families_are_recognised_and_prose_is_left_alone():
    classes, weights, bias = L.fitted()

    def best(line):
        return classes[int(np.argmax(bias + sum((weights[g] for g in L.grams_of(L.words_of(line)) if g in weights), np.zeros(len(bias)))))]

    for family, lines in L.TEMPLATES.items():
        assert [best(x) for x in lines] == [family] * len(lines)
    assert {best(x) for x in L.NONE_EXAMPLES} == {"none"}
    assert {best(x) for x in ("", "Stone walls and old trees", "der und die das")} == {"none"}


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
    "gpl": " * This program is free software: you can redistribute it and/or modify\r\n * it under the terms of the GNU General Public License as published by\r\n * the Free Software Foundation, either version 3 of the License, or",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files",
}


def test_wrapped_notices_keep_their_family(spark):
    rows = [(i, f"Stone walls\n\n{t}\n\nand old trees") for i, t in enumerate(WRAPPED.values())] + [(0, "Stone walls\n\nReleased under the MIT License.\nwhere\n\nold trees stand")]
    got = sorted((r.doc_id, r.line_no, r.family) for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(i, 2, f) for i, f in enumerate(WRAPPED)] + [(0, 2, "mit")])


def test_a_null_id_keeps_its_family(spark):
    rows = [(None, "Released under the MIT License"), (None, "Released under the MIT License"), (None, f"a\n{WRAPPED['bsd']}")]
    got = sorted((r.doc_id, r.line_no, r.family) for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(None, 0, "mit"), (None, 0, "mit"), (None, 1, "bsd")]


def test_whole_notices_prose_and_other_licences(spark):
    """Notices as files have them: each gives its family and no other; other licences are unknown at most; prose is left alone."""
    import notices as T

    rows, want = [], {}
    for family, texts in T.FAMILIES.items():
        for t in texts:
            want[len(rows)] = family
            rows.append((len(rows), f"Stone walls stand.\n\n{t}\n\nOld trees grow."))
    for t in T.FOREIGN:
        want[len(rows)] = "unknown"
        rows.append((len(rows), t))
    for t in T.PROSE:
        rows.append((len(rows), t))
    got = {}
    for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    named = {d: got.get(d, set()) - {"unknown"} for d, f in want.items() if f != "unknown"}
    assert all(g <= {want[d]} for d, g in named.items())  # no other family
    assert [rows[d][1] for d, g in named.items() if not g] == ["Stone walls stand.\n\nLicense: MIT License\n\nOld trees grow."]  # too short for a template: unknown
    assert all(got.get(d, set()) <= {"unknown"} for d, f in want.items() if f == "unknown")
    assert sum(d in got for d, f in want.items() if f == "unknown") >= len(T.FOREIGN) - 1
    assert not set(got) - set(want)


def test_each_paragraph_of_a_notice_is_found(spark):
    import notices as T

    rows = [(0, T.MIT), (1, T.BSD), (2, T.gnu("General Public License", "program")), (3, T.APACHE)]
    got = {}
    for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.family != "unknown":
            got.setdefault(r.doc_id, set()).add(r.template)
    assert [len(got[d]) >= n for d, n in ((0, 3), (1, 4), (2, 3), (3, 3))] == [True] * 4, got
