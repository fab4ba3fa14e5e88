"""Licence scans against a plain version that tries every run of lines, and layouts that must not matter."""

import random
import textwrap

import pytest

from quadloom.llm import licenses


def plain_hits(text, known):
    """Every run of whole lines whose canonical form is known: (licences, number of runs, whether one is all of it)."""
    # line breaks that a spelling rule swallows do not begin or end a run
    lines = [x for x in (text or "").split("\n")]
    out, spans = set(), set()
    forms = [licenses.canonical(x) for x in lines]
    used = [i for i, f in enumerate(forms) if f]
    for a in range(len(used)):
        for b in range(a, len(used)):
            form = licenses.canonical("\n".join(lines[used[a] : used[b] + 1]))
            if form in known:
                out.add(known[form])
                spans.add((a, b))
    return ",".join(sorted(out)), len(spans), (0, len(used) - 1) in spans


SCHEMA = "doc_id long, text string, licenses string, digest string, whole int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], SCHEMA)


def test_against_every_run_of_lines(spark):
    rng = random.Random(12)
    pieces = [*licenses.TEXTS.values(), licenses.MPL_HEADER, licenses.APACHE_HEADER, "MIT License", "Released under the ISC Licence", "prose about nothing", "", "  ", "Copyright (c) 2024 Somebody", "All rights reserved.", "SPDX-License-Identifier: Apache-2.0", "* GPL v3"]
    texts = [(None, "MIT License"), (0, None), (1, ""), (2, "\n \n"), (2, "ISC License"), (2, "MIT License")]
    for i in range(3, 60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(pieces)
            if rng.random() < 0.5:
                piece = "\n\n".join(textwrap.fill(p, rng.choice([40, 72])) for p in piece.split("\n\n"))
            parts.append(piece.upper() if rng.random() < 0.2 else piece)
        texts.append((i, rng.choice(["\n", "\n\n", "\r\n\r\n"]).join(parts)))
    known = licenses.known_texts()
    got = {r.doc_id: (r.licenses, r.n_hits, r.whole) for r in licenses.scan(frame(spark, texts)).collect()}
    assert set(got) == {i for i, _ in texts}
    for i, text in texts[6:]:
        assert got[i] == plain_hits((text or "").replace("\r", "\n"), known), text
    assert got[None] == ("MIT", 1, True) and got[0] == got[1] == ("", 0, False) and got[2] == ("ISC,MIT", 2, True)


def test_layout_and_length_do_not_matter(spark):
    apache = (licenses.FOLDER / "Apache-2.0").read_text()
    texts = [
        (1, licenses.MIT.replace("\n\n", "\n" * 1500)),
        (2, "\n".join(f"Copyright (c) {1000 + i} Holder {i}" for i in range(3000)) + "\n\n" + licenses.MIT),
        (3, "# Tool\n\nWhat it does.\n\n" + textwrap.fill(licenses.MIT.split("\n\n")[0], 60) + "\n\n" + "\n\n".join(licenses.MIT.split("\n\n")[1:]) + "\n\nThanks."),
        (4, licenses.TEXTS["BSD-3-Clause"].replace(". ", ".\n").replace("copyright", "COPYRIGHT")),
        (5, licenses.TEXTS["BSD-2-Clause"]),
        (6, apache),
        (7, "word " * 50_000 + "\n\n" + apache.partition("END OF TERMS")[0]),
        (8, licenses.MIT.replace("without restriction", "with restrictions")),
        (9, licenses.GNU_HEADER.format(name="GNU Lesser General Public License", version="2.1")),
        (10, (licenses.FOLDER / "GPL-2.0").read_text().upper().replace("\n", "\r\n\n")),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert {i: r.licenses for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "BSD-3-Clause", 5: "BSD-2-Clause", 6: "Apache-2.0", 7: "Apache-2.0", 8: "", 9: "LGPL-2.1", 10: "GPL-2.0"}
    assert [i for i in sorted(got) if got[i].whole] == [1, 2, 4, 5, 6, 9, 10]


@pytest.mark.parametrize("texts", [None, {}])
def test_empty_table_and_no_known_text(spark, texts):
    assert licenses.scan(frame(spark, []), texts).count() == 0
    assert licenses.scan(frame(spark, [(1, "MIT License")]), {}).first().n_hits == 0
