"""License scans on planted directories, and against cosines of all segments. Rows are held against SQL in test_sql."""

import math
import re
from collections import Counter

from sparkarray.llm import licenses

MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def pieces(text: str) -> list[str]:
    """Lines, paragraphs, sentences and all."""
    out = [text, *text.split("\n")]
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        if re.search(r"[^\W_]", line):
            block.append(line)
        elif block:
            out += [" ".join(block), *re.split(r"(?<=[.!?])[\x20\x09-\x0D]+", " ".join(block))]
            block = []
    return out


def test_nearest_ancestor(spark):
    filler = "nothing of that kind is said in these plain words about rain and wind"
    rare = " ".join(f"rare{k}" for k in range(40))
    rows = [(0, MIT, "b", "a"), (1, GPL, "c", "a/b"), (2, filler, "x", "a/b/c"), (3, filler, "q", "a/b"), (4, filler, "x", "z"), (5, f"{rare}\n{GPL}\n{filler}", "b", "a"), (6, None, None, None), (7, filler, "bc", "a")]
    rows += [(10 + k, filler + f" {k}", "x", "z") for k in range(30)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert [got[k] for k in range(6)] == [("MIT", "file"), ("GPL-3.0", "file"), ("GPL-3.0", "inherited"), ("MIT", "inherited"), ("", "none"), ("GPL-3.0", "header")]
    assert got[6] == ("", "none") and got[7] == ("", "none")


def test_all_segments(spark):
    """The anchors leave out no segment that reaches the threshold."""
    texts = [MIT, MIT + " See file.", GPL[:40], "MIT License", "the License version", "All rights reserved by the owner", "rights reserved", "under the the the License", None, ""] + [f"plain {k} words under the wind" for k in range(40)]
    rows = [(k, t, "en", f"s{k}") for k, t in enumerate(texts)]
    n = len(rows)
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    df = Counter(x for t in texts for x in set(split(t)))
    idf = lambda x: math.log((n + 1) / (df[x] + 1)) + 1
    vec = lambda t: {x: c * idf(x) for x, c in Counter(split(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, t in enumerate(texts):
        best = []
        for s in pieces(t or ""):
            v = vec(s)
            for name, _, template in licenses.TEMPLATES:
                u = vec(template)
                if v:
                    best.append((name == licenses.WEAKEST, -round(sum(v[x] * u.get(x, 0) for x in v) / norm(v) / norm(u), 6), name))
        _, s, name = min((b for b in best if -b[1] >= licenses.LEAST_COSINE), default=(False, 0, ""))
        want[k] = name if -s >= licenses.LEAST_COSINE else ""
    got = {r.doc_id: r.license if r.origin in ("file", "header") else "" for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == want and any(want.values())


def wrapped(text: str, width: int, lead: str = "") -> str:
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(lead + line.rstrip())
            line = ""
        line += w + " "
    return "\n".join([*out, lead + line.rstrip()])


def test_whole_licences_and_wrapped_headers(spark):
    """Licence files with names and years, headers in comments with broken lines, notices within a paragraph."""
    from sparkarray.llm import license_texts as lt

    text = dict(lt.TEXTS[::-1])  # the first of each name
    filler = "the rain and the wind of this land are in no way like the snow of that one and we go on"
    mit = "MIT License\n\nCopyright (c) 2021 A Person\n\n" + "\n\n".join(wrapped(p, 70) for p in (lt._PERMISSION, "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", lt._AS_IS))
    bsd = lambda parts: "Copyright 2019, Somebody Else\nAll rights reserved.\n\n" + "\n\n".join(wrapped(p, 76) for p in parts)
    apache_head = "# Copyright 2020 The Authors\n#\n" + "\n#\n".join(wrapped(p, 70, "# ") for n, p in lt.HEADERS if n == "Apache-2.0" and "ASF" not in p)
    gpl_head = "/*\n" + wrapped(next(p for n, p in lt.HEADERS if n == "GPL-3.0"), 60, " * ") + "\n *\n * More follows.\n */\n" + "\n".join(f"{filler} {k}" for k in range(9))
    gpl_file = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble\n\n" + "\n\n".join(wrapped(p, 72) for n, p in lt.TEXTS if n == "GPL-3.0") + "\n\n" + "\n\n".join([filler] * 60)
    within = filler.capitalize() + ". " + wrapped("This work is licensed under the GNU General Public License, version 2.", 40) + " " + filler.capitalize() + "."
    rows = [
        (0, mit, "MIT", "file"), (1, bsd([lt._BSD_1, lt._BSD_END]), "BSD-2-Clause", "file"), (2, bsd([lt._BSD_1, lt._BSD_3, lt._BSD_END]), "BSD-3-Clause", "file"), (3, text["Unlicense"], "Unlicense", "file"),
        (4, apache_head + "\n" + filler, "Apache-2.0", "header"), (5, gpl_head, "GPL-3.0", "header"), (6, gpl_file, "GPL-3.0", "file"), (7, within, "GPL-2.0", "header"), (8, filler, "", "none"), (9, f"{filler}\n# SPDX-License-Identifier: MPL-2.0\n{filler}", "MPL-2.0", "header"),
    ]
    rows += [(20 + k, filler + f" {k}", "", "none") for k in range(40)]
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(docs_of(spark, [(k, t, "", f"s{k}") for k, t, *_ in rows])).collect()}
    assert got == {k: tuple(want) for k, _, *want in rows}


def test_pattern_of_words():
    words = {"a", "ab", "abc", "b+", "license", "licence", "2"}
    p = re.compile(rf"^{licenses.one_of(words)}$")
    assert all(p.match(w) for w in words) and not any(p.match(w) for w in ("", "abcd", "bb", "licens", "22"))
