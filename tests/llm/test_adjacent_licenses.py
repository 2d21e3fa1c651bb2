"""Licenses: versions and variants, copies side by side, changed and torn copies, all windows."""

import random

import pytest

from treeline.llm.license_align import MIT_GRANT, MPL_HEADER, SHORT, TEMPLATES, Scanner, scan_licenses, words_of

SCHEMA = "doc_id long, text string, source string"
SCANNER = Scanner()
BY_NAME = {t.name: t for t in TEMPLATES}


@pytest.mark.parametrize("name", [t.name for t in TEMPLATES])
@pytest.mark.parametrize("copies", [1, 2, 3])
def test_adjacent_copies_are_found(name, copies):
    text = "Code here. " + f"{BY_NAME[name].text}. " * copies + "End of it"
    found = SCANNER.scan(text)
    assert len(found) == copies and all((m.template, m.license, m.coverage) == (name, BY_NAME[name].license, 1) for m in found)


def test_two_changed_copies():
    text = "Code. This work is licenced under the GNU General Public License, version 3. This work is licenced under the GNU General Public License, version 3. End"
    assert [m.license for m in SCANNER.scan(text)] == ["GPL-3.0"] * 2


@pytest.mark.parametrize(
    "text, license",
    [
        ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("Licensed under CC BY-NC-ND 3.0.", "CC-BY-NC-ND-3.0"),
        ("Apache License, Version 1.1", None),
        ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        ("Licensed under the Apache Licence, Version 2", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License v3.0", "AGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 7", None),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License", "CC-BY-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
        ("Released under the LGPL license", None),
        ("Released under the BSD license", None),
        ("licensed under the MIT License", "MIT"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", None),
        ("all rights were reserved", None),
    ],
)
def test_relatives_are_told_apart(text, license):
    found = SCANNER.scan(f"Some words before it. {text} and some after it.")
    assert [m.license for m in found] == [license] * (license is not None)


def test_torn_copies():
    """Two grants one word apart, and a header with foreign words between its halves."""
    assert [m.license for m in SCANNER.scan(f"{MIT_GRANT} and {MIT_GRANT}")] == ["MIT"] * 2
    words = MPL_HEADER.split()
    for n in (5, 20, 35):
        text = " ".join(words[:18] + [f"foreign{i}" for i in range(n)] + words[18:])
        assert [(m.license, m.coverage) for m in SCANNER.scan(text)] == [("MPL-2.0", 1.0)]


def test_against_all_windows():
    """Changed, cut and mixed notices in small texts: what is reported is a cover, and what any window covers is reported."""
    from treeline.llm.license_align import align

    rng = random.Random(3)
    names = ["Apache-2.0", "MIT", "CC-BY-4.0", "CC-BY-NC-4.0-short", "GPL-3.0", "Proprietary", "Unlicense", "MPL-2.0"]
    some = Scanner(tuple(BY_NAME[n] for n in names))
    covered = missed = 0
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 4)):
            t = words_of(BY_NAME[rng.choice(names)].text)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(["x", "the", "license", "3", ""])
            text += [f"f{rng.randrange(99)}" for _ in range(rng.randint(0, 6))] + [w for w in t if w]
        got = some.scan(" ".join(text))
        for m in got:
            t = some.words[m.template]
            assert len(m.words) >= 0.8 * len(t) and m.end - m.first <= 2 * len(t)
            assert {text[i] for i in m.words} >= some.must[m.template] and {text[i] for i in m.words} <= set(t)
        for name in names:
            t = some.words[name]
            whole = lambda p: len(p) >= 0.8 * len(t) and some.must[name] <= {t[j] for _, j in p}  # noqa: B023, E731
            if any(whole(align(text[a:b], t)) for a in range(len(text)) for b in range(a + len(t) - 2, min(len(text), a + len(t) + (len(t) if len(t) >= SHORT else len(t) // 4)) + 1)):
                covered += 1
                # It is reported, or its words belong to a better match.
                missed += not any(m.template == name for m in got) and not some.matches(name, text)
    assert covered > 200 and missed <= covered // 100


def test_licenses(spark, odd, empty):
    filler = " ".join(f"filler{i}" for i in range(300))
    texts = [f"{filler}\n{t.text}\n{filler}" for t in TEMPLATES] + ["Licensed under the Apache Licence, Version 2.0 " + filler, filler, None]
    got = scan_licenses(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    for r, t in zip(got, TEMPLATES, strict=False):
        assert (r.license, r.coverage) == (t.license, 1.0) and len(r.matches) == 1
    assert got[-3].license == "Apache-2.0" and 0.8 <= got[-3].coverage < 1
    assert got[-2].license is None and got[-1].license is None
    twice = f"Released under the MIT License. {filler} Released under the MIT License."
    assert len(scan_licenses(spark.createDataFrame([(0, twice, "s")], SCHEMA)).first().matches) == 2
    assert scan_licenses(odd).filter("license IS NOT NULL").count() == 0 and scan_licenses(odd).count() == odd.count() and scan_licenses(empty).count() == 0


def test_a_very_long_text():
    """A million words with notices here and there."""
    filler = [f"word{i % 977}" for i in range(1_000_000)]
    for k in range(0, 1_000_000, 100_000):
        filler[k] = BY_NAME["GPL-3.0"].text
    assert len(SCANNER.scan(" ".join(filler))) == 10


def test_the_query_against_a_plain_search(spark, docs):
    """The notices that stand word for word in the documents are those that the operator finds."""
    rows = {r.doc_id: [m.template for m in r.matches] for r in scan_licenses(docs).collect()}
    for r in docs.collect():
        words = " ".join(["", *words_of(r.text), ""])
        for t in TEMPLATES:
            if t.name in ("Apache-2.0", "MIT", "CC-BY-NC-4.0-short", "GPL-3.0", "Proprietary"):
                n = words.count(f" {' '.join(words_of(t.text))} ")
                assert rows[r.doc_id].count(t.name) >= n
