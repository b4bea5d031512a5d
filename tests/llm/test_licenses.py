import math
import re
import string

from runscope.llm import licenses, notices

SCHEMA = "doc_id long, text string, words string, labels string, key int"


def split(text):
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def contained(words):
    """{template: part of its words} of those that reach the threshold, by definition."""
    own = set(words)
    parts = {k: len(own & t) / len(t) for k, t in enumerate(set(split(t)) for *_, t in notices.TEMPLATES)}
    return {k: p for k, p in parts.items() if p >= licenses.THRESHOLD - 1e-12}


def base_of(text):
    words = split(text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))


BSD_LINE = "Redistribution and use in source and binary forms, with or without modification, are permitted"
TEXTS = [
    (None, ""), ("", ""), (" ,. ", ""), ("Released under the MIT License.", "mit"), ("UNDER THE MIT LICENSE under the mit license", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("licensed under cc by 4.0", "cc-by"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("the apache license, version 2.0", "apache-2"),
    ("Licensed under the\nApache License, Version 2.0.", "apache-2"), ("license under released the mit words in any order", ""), ("é under the mit licenseé", ""),
    ("x " * 5000 + BSD_LINE + " y" * 5000, "bsd"), ("MIT license under the", ""), ("cc by nc", "cc-by-nc"), ("by cc nc", ""), ("KKelvin İ É", ""),
    ("Licensed under CC-BY-SA 3.0", "cc-by-sa"), ("licensed under the GNU General Public License v3", "gpl-3"), ("licensed under the Foo Public License version 2.0", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this material and associated documentation files", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted " * 40, "isc"), ("the public license of the people was under the hill", ""),
    (notices.MIT_TEXT, "mit"), (notices.MIT_TEXT.replace("Software", "Material", 3).replace("sell copies", "peddle copies"), "mit"), (notices.ISC_TEXT, "isc"), (notices.BSD_TEXT, "bsd"), (notices.ZLIB_TEXT, "zlib"),
    (notices.UNLICENSE_TEXT, "unlicense"), (notices.APACHE_NOTICE, "apache-2"), (notices.GPL_3_NOTICE, "gpl-3"), ("z " * 777 + notices.BSD_TEXT + " y" * 300 + notices.ISC_TEXT, "bsd,isc"),
]


def test_scan_labels_notices_and_whole_license_texts(spark):
    texts = TEXTS + [("w " * k + t, label) for k in (22, 23, 24, 25, 47, 48, 200) for t, label in TEXTS[3:11]]
    rows = [(k, t, "clash", "clash", 1) for k, (t, _) in enumerate(texts)] + [(3, "another text of the same id", "", "", 1), (4, TEXTS[4][0], "", "", 1), (None, TEXTS[5][0], "", "", 1)]
    labels = [label for _, label in texts] + ["", "mit", "cc-by-nc"]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    flat = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got), key=str)
    assert flat == sorted(((i, *base_of(t), label) for (i, t, *_), label in zip(rows, labels, strict=True)), key=str)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_stretch_that_meets_the_threshold_is_in_a_similar_block(spark):
    rows = [(k, t) for k, (t, _) in enumerate(TEXTS) if t and len(t) < 9000] + [(100 + k, "v " * k + BSD_LINE + " u" * 9 + notices.MIT_TEXT) for k in (0, 5, 23, 95, 191)]
    found = {}
    for r in licenses.similar_blocks(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect():
        words = split(dict(rows)[r["doc_id"]])[r["block"] : r["block"] + 2 * r["step"]]
        assert math.isclose(r["containment"], contained(words)[r["template"]])  # none that does not reach it
        found.setdefault(r["doc_id"], set()).add(r["template"])
    steps = [licenses.step_for(len(split(t))) for *_, t in notices.TEMPLATES]
    assert all(4 * s >= 5 * len(split(t)) for s, (*_, t) in zip(steps, notices.TEMPLATES, strict=True))
    checked = 0
    for i, t in rows:
        words = split(t)
        for step in set(steps):
            for a in range(max(1, len(words) - step + 1)):  # every start, not the blocks' own
                met = {k for k in contained(words[a : a + step]) if steps[k] == step}
                assert met <= found.get(i, set())
                checked += len(met)
    assert checked > 200


def test_a_long_template_of_the_caller_matches_its_own_text(spark):
    text = " ".join(f"word{k}" for k in range(700))
    docs = spark.createDataFrame([(1, "before " * 33 + text + " after"), (2, text.replace("word7", "x", 60)), (3, " ".join(text.split()[:500]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, templates=(("own", ("word1",), text),)).collect()}
    assert got[1] == ("own", 1.0) and got[2][0] == "own" and got[3] == ("", 0.0)


def test_prose_that_holds_the_words_here_and_there_has_no_label(spark):
    prose = [
        "A team at MIT showed a camera in the spring. It was released to press as a license plate reader under test.",
        "You need a license to drive there. Creative people licensed 4 songs, sa va, under cc of 0 and by hand.",
        "The public was licensed by a general under the gnu herd, version 2 of the tale, and the license expired.",
        "Permission to copy was granted for a fee; use of this software or any modification and distribution hereby needs a purpose without doubt, with care.",
        "The author has waived, under law and to the extent it was possible, rights: all related, the copyright and more.",
        "Mozilla said that version 2 of the public terms is subject to license 0.",
    ]
    identifiers = {"SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa", "SPDX-License-Identifier: LGPL-3.0-only": "lgpl-3", "SPDX-License-Identifier: ISC": "isc"}
    near = {f"{a} {b}": "mit" for a in ("Some prose before it.", "") for b in ("released under the MIT license", "Released, under the MIT License!")}
    rows = [(k, t, "", "", 0) for k, t in enumerate([*prose, *identifiers, *near])]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(len(rows))] == [""] * len(prose) + [*identifiers.values(), *near.values()]
