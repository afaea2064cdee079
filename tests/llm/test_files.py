"""HTML extraction, licence scans, archives and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import re
import time
from collections import Counter

import pytest

import corpus_pipeline
from tallyloom.llm import html_extract, license_scan, queries, warc
from tallyloom.llm.tables import new_path, save

LONG = "The river runs to the sea and it is not for us to say what was there before the town, because all of them have been with it. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><nav><a>Home</a></nav><article><h1>Title &amp; more</h1><p>One\n two<br>three<p>***&lt;b&gt;</article><footer>x</footer>", "Title & more\nOne two three\n***<b>"),
        ("<div class='ad'>Buy</div><main><p>Text</p><aside>side</aside><div id=comments><p>me too</p></div></main><script>if (a<b) '</p>'</script>", "Text"),
        ("<article><header><h1>Head</h1></header><p>A <a href=x>link</a> inside.</p><form><p>mail</p></form><div class='cookie-notice'>ok?</div></article><article class=comment>no</article>", "Head\nA link inside."),
        (f"<body><div><a>menu one</a> <a>menu two</a></div><h2>On it</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><p>xx yy zz</p></body>", f"On it\n{LONG.strip()}\nShort one.\n{LONG.strip()}"),
        ("<article><p>a<!-- <p>no</p> --> b &copy 2</p><style>p{}</style><div hidden>gone</div><img alt=x/>c", "a b © 2\nc"),
        ("<article>unclosed <b>bold <i>x", "unclosed bold x"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_both_passes_run_with_containers():
    links = "<ul><li><a href=x>One of the other stories</a></li><li><a href=y>And one more of them</a></li></ul>"
    assert html_extract.main_text(f"<article><h1>Head</h1><p>{LONG}</p>{links}<p>Last.</p></article>") == f"Head\n{LONG.strip()}\nLast."
    cards = "".join(f"<article><h2><a href={i}>Card number {i}</a></h2><p>Teaser {i}</p></article>" for i in range(3))
    assert html_extract.main_text(f"<body><div>{LONG}</div><div>{LONG}</div>{cards}</body>") == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("start", ["<body class='single has-sidebar'>", "<body class=sidebar>", "<div class='content comments-open'>", "<section id=discussion>", "<article class='post social-history'>", "<div class=share-price>"])
def test_names_that_only_hold_a_part_name(start):
    assert html_extract.main_text(f"{start}<h2 id=related>On it</h2><p>{LONG}</p>") == f"On it\n{LONG.strip()}"
    assert html_extract.main_text(f"<div class='sidebar-left comment-12'>{LONG}</div>") == ""


def test_language_without_known_stop_words():
    text = "Joki virtaa mereen eikä kukaan tiedä mitä siellä oli ennen kaupunkia. " * 4
    assert html_extract.main_text(f"<div><a href=x>Etusivu</a></div><p>{text}</p>") == text.strip()


def test_every_page_goes_through_both_passes(monkeypatch):
    seen = []
    plain = html_extract.second_pass
    monkeypatch.setattr(html_extract, "second_pass", lambda *a: seen.append(a) or plain(*a))
    pages = [f"<article><p>{LONG}</p></article>", f"<div class=x><div><p>{LONG}</p><p>{LONG}</p></div><div class=y><a href=1>One</a> <a href=2>Two</a></div></div>", f"<main><p>{LONG}</p></main>"]
    assert [html_extract.main_text(x) for x in pages] == [LONG.strip(), f"{LONG.strip()}\n{LONG.strip()}", LONG.strip()]
    assert len(seen) == len(pages)


def test_references_in_links_count_decoded():
    text = "The one that is <a href=x>&auml;&auml;&auml;&auml;</a> and it was not for us to say what was there before all of them came to be in it"
    assert html_extract.main_text(f"<p>{text}</p>").startswith("The one that is ääää")


@pytest.mark.parametrize("name", ["post-comments", "user-comment", "userComment", "cookie-banner-wrapper-main", "ad-slot-1", "newsletter-box-cta", "sidebar-primary", "article-sidebar", "comment-body", "main-menu", "site-footer"])
def test_compound_names_are_out(name):
    page = f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG[::-1]} and so it is for the one who is in it, as was said of it</p></div></article></body>"
    assert html_extract.main_text(page) == LONG.strip()


@pytest.mark.parametrize("name", ["content comments-open", "has-sidebar", "share-price", "related-work", "social-history", "post no-sidebar", "discussion", "price-share"])
def test_names_of_other_things_stay(name):
    assert html_extract.main_text(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == LONG.strip()


def test_doubtful_names_by_links_and_length():
    links = "".join(f"<p><a href=x{i}>Read on about the {i} of it</a></p>" for i in range(4))
    assert html_extract.main_text(f"<article><p>{LONG}</p><div class='story-related'>{links}</div><div class='post-share'><p>Tell the others of it.</p></div><p>End of it.</p></article>") == f"{LONG.strip()}\nEnd of it."


def test_short_pages_and_labels():
    assert html_extract.main_text("<body><p>Short note.</p></body>") == "Short note."
    assert html_extract.main_text("<body><nav>All of the menu</nav><p>Note.</p><p>A longer note.</p><p><a href=x>Next page of it all</a></p></body>") == "A longer note."
    assert html_extract.main_text("<body><nav>All of the menu</nav></body>") == ""
    assert html_extract.main_text(f"<div><p>{LONG}</p><label for=x>Your mail address</label><input id=x></div>") == LONG.strip()


def test_long_broken_pages_take_linear_time():
    page = "<p>" + "<span class=a></b></i>word </u>" * 40_000 + "".join(f"<p>short {i}" for i in range(20_000))
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 20


def test_extract(spark):
    rows = [(1, "u", "<article>é</article>", "t"), (None, None, None, None), (1, "u", "<article>é</article>", "t")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]


def plain_idf(texts):
    """Of every word of some files and of the templates: log(1 + files / files that hold it)."""
    df = Counter(w for t in texts for w in set(re.findall("[a-z0-9]+", (t or "").lower())))
    known = {w for bag in license_scan.template_bags() for w in bag}
    return {w: math.log(1 + len(texts) / max(1, df[w])) for w in known | set(df)}


def brute_license(segment, idf):
    bag = {w: n * idf[w] for w, n in Counter(re.findall("[a-z0-9]+", segment.lower())).items()}
    length = math.sqrt(sum(x * x for x in bag.values())) or 1.0
    unit = license_scan.template_vectors(idf)
    score, at = max((round(sum(bag.get(w, 0) * x for w, x in v.items()) / length, 9), -i) for i, v in enumerate(unit))
    return (license_scan.TEMPLATES[-at][0], score) if score >= 0.75 else None


def brute_segments(text):
    lines = text.split("\n")
    return [*lines, *(x for line in lines for x in re.split(r"(?<=[.;!?])\s+(?=\S)", line) if x), *(x for x in re.split("\n[ \t\r]*\n", text) if "\n" in x)]


def test_key_words_are_necessary():
    idf = plain_idf(["the software is licensed to the public", "of the and"])
    unit = license_scan.template_vectors(idf)
    keys = license_scan.key_words(unit, 0.75)
    for v in unit:
        assert math.isclose(sum(x * x for x in v.values()), 1)
        assert math.sqrt(sum(x * x for w, x in v.items() if w not in keys)) < 0.75 and keys & set(v)


LICENSED = "Licensed under the Apache License, Version 2.0."


def test_license_scan(spark):
    mit = max((t for n, t in license_scan.TEMPLATES if n == "MIT"), key=len)
    files = {
        "a/LICENSE": "Released under the MIT License.",
        "a/x.py": "code\ncode",
        "a/b/y.py": f"intro text on one program\n{LICENSED}\nmore code follows there and then some other things go on and on",
        "a/b/c/z.py": "",
        "a/c/COPYING": "This work is licensed under the GNU General Public License, version 3.",
        "a/c/d/w.py": "text on public matters",
        "top.py": None,
        "a/c/d/e/odd.py": "he licensed under version of the public",
        "m/legal": mit.replace("Copyright (c)", "Copyright (c) 2020 Someone Else\n\n"),
        "m/n/o.py": "print",
        "p/long.py": f"Some words come first, and then. {LICENSED} And more words follow here.",
    }
    files |= {f"q/{i}.py": f"the code of file {i} is in this and that, it is for you and of the {i} kind" for i in range(30)}
    rows = [(p, t, "c") for p, t in files.items()] + [(None, LICENSED, "c"), ("a/x.py", "code\ncode", "c")]
    out = {r.path: r for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string, license string")).collect()}
    assert set(out) == set(files)
    assert [(out[p].license, out[p].origin, out[p].source) for p in [*files][:11]] == [
        ("MIT", "file", "a/LICENSE"),
        ("MIT", "inherited", "a/LICENSE"),
        ("Apache-2.0", "header", "a/b/y.py"),
        ("MIT", "inherited", "a/LICENSE"),
        ("GPL-3.0", "file", "a/c/COPYING"),
        ("GPL-3.0", "inherited", "a/c/COPYING"),
        (None, None, None),
        ("GPL-3.0", "inherited", "a/c/COPYING"),
        ("MIT", "file", "m/legal"),
        ("MIT", "inherited", "m/legal"),
        ("Apache-2.0", "header", "p/long.py"),
    ]
    idf = plain_idf([t for p, t, _ in rows if p is not None])
    for path in files:
        found = [x for x in (brute_license(s, idf) for s in brute_segments(files[path] or "")) if x]
        if out[path].origin == "header":
            assert out[path].score == pytest.approx(max(score for _, score in found))
        elif out[path].origin != "file":
            assert not found
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_notices_license_no_neighbours(spark):
    """A file that holds only a notice licenses itself; wordings that notices use."""
    wordings = {
        "SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
        "This project is licensed under the MIT License - see the LICENSE.md file for details.": "MIT",
        "This file is distributed under the MIT License.": "MIT",
        "Licensed under the GNU General Public License, version 2 or later.": "GPL-2.0-or-later",
        "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    }
    files = {f"d{i}/1": text for i, text in enumerate(wordings)} | {f"d{i}/{j}": f"the words of file {i} are {j} other ones" for i in range(7) for j in (2, 3)}
    files |= {f"w/{i}": f"plain text number {i} with a word or two of the {i} kind and what it is about" for i in range(60)}
    out = {r.path: r for r in license_scan.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert [(out[f"d{i}/1"].license, out[f"d{i}/1"].origin) for i in range(7)] == [(v, "header") for v in wordings.values()]
    assert all(r.license is None for p, r in out.items() if not p.endswith("/1") or p.startswith("w/"))


def test_license_query_with_nulls(spark, tmp_path):
    rows = [(1, LICENSED, "en", "a/b"), (None, LICENSED, "fr", "s"), (3, None, None, None), (None, "plain", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_license_scan(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.path, r.license or "") for r in out) == [(0, "s/-/-", ""), (0, "s/fr/-", "Apache-2.0"), (1, "a_b/en/1", "Apache-2.0"), (3, "-/-/3", "")]


def test_chunked_framing():
    for n in (0, 1, 4096, 10_000):
        payload = os.urandom(n)
        assert warc.dechunked(warc.chunked(payload, 4096)) == payload
    with pytest.raises(ValueError, match="cut off"):
        warc.dechunked(b"ff\r\nshort")


def test_archive(spark):
    big = "<p>é\r\n\r\n" + "y" * 3000
    rows = [(1, "http://a b", big, "x"), (2, None, big, "x"), (3, "u", "small", "x"), (4, "u", "small", "x"), (5, "u", None, "x"), (6, "u", "Z" * 70_000, "x"), (None, "u", big, "x")]
    p = warc.Archive(segment_bytes=1500, chunk_bytes=700, records_per_file=3)
    path = new_path(spark, "warc")
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), path, p).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6, None}
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest, out[i].whole) == (len(payload), hashlib.sha1(payload).hexdigest(), True)
    assert {i: r.refers_to for i, r in out.items() if r.record_type == "revisit"} == {1: 2, None: 2} or out[None].record_type == "response"


def test_missing_segment(spark):
    p = warc.Archive(segment_bytes=500, chunk_bytes=700)
    made = list(warc.records_of(1, "u", b"q" * 2000, None, p))
    data = warc.END.join(made[:1] + made[2:]) + warc.END
    folder = new_path(spark, "warc").removeprefix("file://")
    os.makedirs(folder)
    with open(f"{folder}/a.txt.gz", "wb") as f:
        f.write(gzip.compress(data))
    out = warc.records(spark, folder).collect()
    assert [(r.page_id, r.whole, r.payload_bytes) for r in out] == [(1, False, None)]


def test_pipeline(spark, tmp_path):
    good = "the old {} walks by the river and sings of stone and rain while children sleep near fire number {}"
    texts = ["\n".join(good.format(w, i * 31 + j) + " " + " ".join(f"{w}{i}{k}" for k in range(12)) for j, w in enumerate(("fox", "cat", "owl"))) for i in range(40)]
    leak = "what is the name of the seventh moon that the captain saw on the night of the great storm"
    texts[7] += "\n" + leak
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(["*** ###"] * 30), "en", "s", 9) for i in range(20)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, folder), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(40)) and 7 in kept[2] and 7 not in kept[3] and kept[3] >= kept[2] - {7}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept[3]


def test_pipeline_keeps_one_of_each_class(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(40))
    rows = [(2, a), (1, b), (1, c), (None, a), (None, "lone text of its own"), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert out == sorted([(1, b), (1, c), (0, "lone text of its own"), (5, None), (6, "")], key=str)
