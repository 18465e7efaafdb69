import random
import re

import rows
from tidewatch.llm import licenses


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(found):
    return [" ".join(found[i : i + 5]) for i in range(len(found) - 4)]


def found_in(wanted, own):
    return len(wanted & set(own)) / len(wanted)


def expected(docs, templates, share=0.8):
    """Every window of every text against every template (name, license, text)."""
    held = {name: set(shingles(words(text))) for name, _, text in templates}
    license_of = {name: license_name for name, license_name, _ in templates}
    found = {}
    for name, wanted in held.items():
        if not wanted:
            continue
        rivals = [held[u] for u in held if license_of[u] != license_of[name] and found_in(wanted, held[u]) >= share]
        step = 1
        while step < len(wanted):
            step *= 2
        for key, doc in docs:
            own = shingles(words(doc))
            for start in range(0, len(own), step):
                part = found_in(wanted, own[start : start + 2 * step])
                around = own[max(0, start - 2 * step) : start + 4 * step]
                if part >= share and all(found_in(rival, around) <= part for rival in rivals):
                    old = found.get((key, name), (0, start))
                    found[key, name] = (max(old[0], part), min(old[1], start))
    return found


def scanned(spark, docs, templates):
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, band int, words string")
    known = spark.createDataFrame(templates, "template_id string, license string, text string")
    return {(r.doc_id, r.template_id): (r.containment, r.first_word) for r in licenses.scan(table, known).collect()}


def test_scan_equals_all_windows(spark):
    draw = random.Random(4)
    notices = [text for _, text in licenses.NOTICES.values()]
    docs = []
    for key in range(120):
        filler = [" ".join(draw.choices(["the", "work", "license", "under", "of", "4"], k=draw.randrange(30))) for _ in range(3)]
        notice = draw.choice(notices).split()
        if key % 3 == 0:
            notice[draw.randrange(len(notice))] = "changed"
        docs.append((key, f"{filler[0]}. {' '.join(notice)} {filler[1]}\n{draw.choice(notices).upper()} {filler[2]}"))
    docs += [(200, "Released under the MIT License. " * 300), (201, ""), (202, None), (203, "MIT"), (None, "Released under the MIT License.")]
    templates = licenses.template_rows()
    out = scanned(spark, docs, templates)
    assert out == expected(docs, templates)
    assert any(held < 1 for held, _ in out.values())


def test_whole_altered_and_straddling_licenses(spark):
    draw = random.Random(6)
    templates = licenses.template_rows()
    docs = []
    for key, (name, text) in enumerate(licenses.WHOLE.items()):
        for shift in (0, 100, 250, 1000):
            filler = " ".join(f"w{draw.randrange(500)}" for _ in range(shift))
            parts = text.split()
            for _ in range(len(parts) // 60):
                parts[draw.randrange(len(parts))] = "altered"
            docs += [(len(docs), f"{filler} {text} {filler}"), (len(docs) + 1, f"{filler} {' '.join(parts)}")]
    out = scanned(spark, docs, templates)
    assert out == expected(docs, templates)
    for i, (key, _) in enumerate(docs):
        name = list(licenses.WHOLE)[i // 8]
        assert (key, f"whole-{name}") in out
        if i % 2 == 0:
            assert out[key, f"whole-{name}"][0] == 1


def test_near_relatives_are_told_apart(spark):
    texts = [licenses.NOTICES[f"{name}-redistribute"][1] for name in ("agpl", "lgpl", "gpl")]
    texts += [licenses.WHOLE["BSD-2-Clause"], licenses.WHOLE["BSD-3-Clause"], licenses.WHOLE["0BSD"], licenses.WHOLE["ISC"]]
    out = scanned(spark, list(enumerate(texts)), licenses.template_rows())
    licensed = {key: {name for k, name in out if k == key} - {"bsd-redistribution"} for key in range(len(texts))}
    assert licensed == {
        0: {"agpl-redistribute"},
        1: {"lgpl-redistribute"},
        2: {"gpl-redistribute"},
        3: {"whole-BSD-2-Clause"},
        4: {"whole-BSD-3-Clause"},
        5: {"whole-0BSD"},
        6: {"whole-ISC"},
    }


def test_templates_of_thousands_of_words(spark, tmp_path, monkeypatch):
    """Long texts, read from files, in blocks: each is found whole, altered and across windows, as by brute force."""
    draw = random.Random(8)
    vocabulary = [f"term{i}" for i in range(400)]
    for i, size in enumerate((700, 1500, 5600)):
        (tmp_path / f"long-{i}.txt").write_text(" ".join(draw.choices(vocabulary, k=size)))
    templates = [tuple(r) for r in licenses.from_files(spark, str(tmp_path)).collect()]
    assert sorted(name for name, _, _ in templates) == ["long-0", "long-1", "long-2"]
    relative = templates[0][2].split()
    relative[300:300] = "one more clause of its own".split()
    templates.append(("relative", "other", " ".join(relative)))
    docs = []
    for name, _, text in templates:
        for shift in (0, 333, 9000):
            parts = text.split()
            for _ in range(len(parts) // 40):
                parts[draw.randrange(len(parts))] = "altered"
            filler = " ".join(f"w{draw.randrange(500)}" for _ in range(shift))
            docs += [(len(docs), f"{filler} {text}"), (len(docs) + 1, f"{filler} {' '.join(parts)} {filler}")]
    docs.append((99, " ".join(templates[2][2].split()[:300])))
    monkeypatch.setattr(licenses, "BLOCK", 3000)
    out = scanned(spark, docs, templates)
    assert out == expected(docs, templates)
    assert {key for key, _ in out} >= {i for i in range(len(docs) - 1) if i % 2 == 0}


def test_bands_are_few(spark):
    text = " ".join(f"t{i * i % 7919}" for i in range(7000))
    known = spark.createDataFrame([("long", "L", text), ("short", "S", "one two three four five six")], "template_id string, license string, text string")
    bands = {r.template_id: len(r.bands) for r in licenses.prepared(known, 0.8).collect()}
    assert 50 <= bands["long"] <= 64 and bands["short"] == 2


def test_tags(spark):
    texts = [
        "// SPDX-License-Identifier: MIT\nint x;",
        "a b SPDX-License-Identifier: (MIT OR Apache-2.0) c\nd SPDX-License-Identifier:GPL-2.0-only WITH Classpath-exception-2.0",
        "SPDX-License-Identifier: ISC. And then SPDX-License-Identifier: ISC",
        "SPDX-License-Identifier: \n",
        None,
        "",
    ]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], "doc_id long, text string, license string")
    out = {(r.doc_id, r.license, r.first_word) for r in licenses.scan_tags(table).collect()}
    second = len(words(texts[1][: texts[1].rindex(licenses.TAG)]))
    assert out == {
        (0, "MIT", 0), (None, "MIT", 0), (1, "MIT", 2), (1, "Apache-2.0", 2), (1, "GPL-2.0-only", second), (2, "ISC", 0),
    }
    assert licenses.scan_tags(rows.awkward(spark, license="x")).count() == 0
    assert licenses.scan_tags(rows.empty(spark)).count() == 0


def test_awkward_rows_and_empty_tables(spark):
    templates = spark.createDataFrame([("t", "L", "plain text of some few words"), ("short", "L", "two words"), ("none", "L", None)], "template_id string, license string, text string")
    got = licenses.scan(rows.awkward(spark, license="x", template_id="y"), templates).collect()
    assert sorted(r.doc_id for r in got) == [1, 6]
    assert licenses.scan(rows.empty(spark), templates).count() == 0
    assert licenses.scan(rows.awkward(spark), templates.where("template_id <> 't'")).count() == 0
