import textwrap

import duckdb
import numpy as np
import pytest

from tollgate.llm import license_scan as L


@pytest.fixture(scope="module")
def model():
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where n_chars < 20000 order by doc_id limit 200").fetchall()
    return L.fit([x for (t,) in rows for x in t.split("\n")][:1500])


def families(model, text):
    return [(line, f) for line, f, p, s in L.scan_text(model, text.encode()) if s >= L.CONFIRM]


def test_templates_and_their_variants(model):
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            assert (1, family) in families(model, f"Some first line here.\n{t}\nlast line"), t
    assert families(model, "Foo (c) 2020. Licensed under the Apache License, Version 2.0, see file") == [(0, "apache")]
    around = " ".join(f"zz{i}" for i in range(300))
    long = f"{around} Licensed under the Apache License, Version 2.0. {around}"
    assert families(model, long) == [(0, "apache")]


def test_unknown_class(model):
    for t in ("", "\n\n", "license", "the version of the software", "Licensed under the Foo Bar Agreement 9", "public domain general work"):
        assert families(model, t) == [], t


def test_given_documents(model):
    lines = {"CC BY-NC": "cc-by-nc", "GNU General": "gpl", "Apache": "apache", "MIT License": "mit", "All rights reserved": "proprietary"}
    wrong = 0
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall():
        expected = {(i, f) for i, x in enumerate(text.split("\n")) for k, f in lines.items() if k in x}
        wrong += expected != set(families(model, text))
    assert wrong == 0


def test_probabilities_are_calibrated(model):
    r = np.random.default_rng(11)
    sample = L._variants(r, [f"zz{i}" for i in range(50)])
    words = L.hash_words(" ".join(w for s, _ in sample for w in s).encode())[0]
    p = L._scores(model, words, np.array([len(s) for s, _ in sample]))
    right = p.argmax(axis=1) == np.array([f for _, f in sample])
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.08 and right.mean() > 0.8


@pytest.mark.parametrize("clash", [False, True])
def test_rows(make_docs, model, clash):
    docs = [(1, "a\nReleased under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (None, "Released under the MIT License."),
            (4, "x " * 200_000 + "\nLicensed under CC BY-NC 4.0."), (4, "Released under the MIT License."), (4, "Released under the MIT License.")]
    out = L.scan(make_docs(docs, clash), model).collect()
    got = sorted((str(r.doc_id), [(x.line, x.family) for x in r.found if x.confirmed]) for r in out)
    assert got == sorted([("1", [(1, "mit"), (2, "proprietary")]), ("2", []), ("3", []), ("None", [(0, "mit")]),
                          ("4", [(1, "cc-by-nc")]), ("4", [(0, "mit")]), ("4", [(0, "mit")])])
    assert L.scan(make_docs([])).count() == 0


@pytest.mark.parametrize("width", [40, 60, 72])
@pytest.mark.parametrize("mark", ["", " * "])
def test_wrapped_notices(model, width, mark):
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            lines = [mark + x for x in textwrap.wrap(t, width)]
            if len(lines) > 1:
                text = "\n".join(["Copyright 2020 Someone", "", *lines, "", "something else"])
                assert families(model, text) == [(2, family)], (t, width)


def test_notices_of_two_paragraphs_are_not_joined(model):
    assert families(model, "Licensed under the\n\nMIT\n\nLicense, or not") == []


def test_wrapped_notices_are_no_samples_of_the_unknown_class():
    wrapped = "\n".join(textwrap.wrap(L.TEMPLATES["gpl"][2], 50))
    assert L.paragraphs_of(f"a b\n{wrapped}\n \nc\n\n\nd") == [f"a b\n{wrapped}", "c", "d"]
    templates = [(0, L.words_of(L.TEMPLATES["gpl"][2]))]
    around = [f"zz{i}" for i in range(100)]
    free = L._free_of(templates, [*around, *L.words_of(wrapped), *around])
    assert not free[100:128].any() and free[:60].all() and free[-60:].all()


@pytest.mark.parametrize("text, expected", [
    ("Licensed under the MIT License. Licensed under the Apache License, Version 2.0.", {"mit", "apache"}),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option", {"mit", "apache"}),
    ("Released under the ISC License. Licensed under CC BY-SA 4.0.", {"isc", "cc-by-sa"}),
    ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", {"cc-by", "cc-by-nc"}),
    ("Released under the BSD 3-Clause License.\nLicensed under the Mozilla Public\nLicense, version 2.0.", {"bsd", "mpl"}),
    *((t, {f}) for f, texts in L.TEMPLATES.items() for t in texts)])
def test_all_families_of_a_segment_and_no_other(model, text, expected):
    assert {f for _, f in families(model, text)} == expected


#: names and wording of licences that are in no family
OUTSIDE = [
    *(f"{how} under the {name} License." for how in ("Released", "Licensed", "Distributed")
      for name in ("zlib", "PostgreSQL", "Boost Software", "Boost", "Eclipse", "Artistic", "Python", "OpenSSL", "Ruby", "PHP", "X11 Foo")),
    "Educational Community License, Version 2.0.",
    "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Licensed under the European Union Public License, version 1.2.",
    "This Source Code Form is subject to the terms of the Common Development and Distribution License, v. 1.0.",
    "This work is licensed under the Open Software License, version 3.",
    "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC XX 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, "
    "and without a written agreement is hereby granted",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "Dedicated to the public domain under PDDL 1.0.",
]


@pytest.mark.parametrize("text", OUTSIDE)
def test_licences_of_no_family_are_not_confirmed(model, text):
    assert families(model, text) == []
    around = " ".join(f"zz{i}" for i in range(30))
    assert families(model, f"{around} {text} {around}") == []


@pytest.mark.parametrize("text, family", [
    ("Distributed under the ISC License.", "isc"), ("Released under the terms of the MIT License.", "mit"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Licensed under the GNU General Public License, version 3.", "gpl"),
    ("This file is licensed under the Apache License, Version 2.0", "apache")])
def test_notices_worded_a_little_differently(model, text, family):
    assert families(model, text) == [(0, family)]


def test_a_name_far_away_does_not_confirm(model):
    far = " ".join(f"zz{i}" for i in range(20))
    assert families(model, f"Released under the zlib License. {far} isc {far} License") == []


def test_pieces_of_a_long_text_give_the_words_of_the_whole(model):
    text = ("wörd " * 300_000 + "x" * 1_500_000 + " Released under the MIT License. " + "é, " * 200_000).encode()
    for a, b in zip(L._words(text), L.hash_words(text), strict=True):
        assert np.array_equal(a, b)
    assert families(model, text.decode()) == [(0, "mit")]


@pytest.mark.parametrize("word", ["zz", "yy", "wörd", "é", "the", "license"])
def test_a_word_said_many_times_hides_no_notice(model, word):
    many = f"{word} " * 40
    assert families(model, f"{many}. Released under the MIT License. {many}") == [(0, "mit")]
    assert families(model, many) == []
