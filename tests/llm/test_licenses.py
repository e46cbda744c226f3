"""Licences as they stand in files: wrapped, indented, with names filled in, inside other text; and a plain version."""

import random
import re
import textwrap

import pytest

from kakari.llm import licenses
from kakari.llm.license_texts import BODIES

CASES = {
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "This file is licensed under the terms of the MIT License.": "MIT",
    "// SPDX-License-Identifier: MIT": "MIT",
    "# This project is released\n# under the BSD 3-Clause\n# License.": "BSD-3-Clause",
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "Copyright (c) 2020 A. Author. All rights reserved.": "Proprietary",
    "This work is licensed under the GNU General Public License, version 2": "GPL-2.0",
}


def found(texts):
    return [{r[3].split("/")[0] for r in licenses.Templates(licenses.TEMPLATES, 0.8).find(__import__("pyarrow").array([t]))} for t in texts]


def test_usual_lines():
    assert found(CASES) == [{v} for v in CASES.values()]
    assert found(["the mit of the licence and of the terms under which it is granted", "", "license"]) == [set(), set(), set()]


@pytest.mark.parametrize("name", sorted(n for n in BODIES if n.split("/")[1] in ("body", "notice")))
def test_bodies_wrapped_inside_a_file(name):
    rng = random.Random(name)
    noise = lambda n: " ".join(f"word{rng.randint(0, 999)}" for _ in range(n))
    body = "\n".join(" * " + x for x in textwrap.wrap(BODIES[name], 50))
    # a few words changed, as in filled-in names
    words = body.split(" ")
    for _ in range(max(1, len(words) // 40)):
        words[rng.randrange(len(words))] = "changed"
    (got,) = found([f"{noise(300)}\n/*\n{' '.join(words)}\n*/\n{noise(500)}"])
    assert name.split("/")[0] in got


def plain(text, templates, threshold=0.8):
    cut = lambda s: re.findall("[0-9a-z\x80-\U0010ffff]+", s.lower())
    w, scored = cut(text), []
    for name, body in templates.items():
        t = cut(body)
        b = set(zip(t, t[1:]))
        for i in range(max(1, len(w) - len(t) + 1)):
            own = w[i : i + len(t)]
            a = set(zip(own, own[1:]))
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                scored.append((-len(a & b), -2 * len(a & b) / (len(a) + len(b)), -len(own), i, name))
    return sorted((i, -n, name, -d) for c, d, n, i, name in scored if not any((o[3] <= i - n - 1 and o[3] - o[2] - 1 >= i) and o < (c, d, n, i, name) for o in scored))


def test_against_plain():
    rng = random.Random(2)
    templates = {"A/1": "one two three four five", "B/1": "two three four six", "C/1": "one one one two two", "D/1": "seven", "E/1": ""}
    import pyarrow as pa

    every = licenses.Templates(templates, 0.8)
    hits = 0
    for _ in range(400):
        text = " ".join(rng.choices(["one", "two", "three", "six", templates["A/1"], templates["B/1"], templates["C/1"]], k=rng.randint(0, 9)))
        got = sorted((r[1], r[2], r[3], r[4]) for r in every.find(pa.array([text])))
        assert got == plain(text, templates)
        hits += len(got)
    assert hits > 50
