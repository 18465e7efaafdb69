import zlib

import numpy as np
import pytest
import rows
from pyspark.sql import functions as F
from tidewatch.llm import langid, quality, toxicity
from tidewatch.llm.tables import remainder

SF = "/root/testdata/sf0.01"


def held_out(key, modulus, value):
    return zlib.crc32(str(key).encode()) % modulus == value


def share_right(pairs):
    return np.mean([a == b for a, b in pairs])


def test_code_lengths_equal_the_rule_byte_by_byte():
    texts = ["abracadabra abra", "cadabra", "Brac!"]
    keys, counts = zip(*_fours(texts).items(), strict=True)
    levels = langid.tree(np.array(keys, np.uint32), np.array(counts))
    asked = ["abrakadabra", "xyz", "", "CADA\n"]
    got = langid.code_lengths([levels], asked)[:, 0]
    assert got == pytest.approx([_plain_bits(texts, text) for text in asked])


def _fours(texts):
    found = {}
    for text in texts:
        data = langid.START + text.lower().encode()
        for i in range(3, len(data)):
            key = int.from_bytes(data[i - 3 : i + 1], "big")
            found[key] = found.get(key, 0) + 1
    return found


def _plain_bits(texts, text):
    learned = [langid.START + t.lower().encode() for t in texts]
    data, bits = langid.START + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for depth in (3, 2, 1, 0):
            context = data[i - depth : i]
            after = [t[j] for t in learned for j in range(3, len(t)) if t[j - depth : j] == context]
            if not after:
                continue
            total = len(after) + len(set(after))
            if data[i] in after:
                bits -= np.log2(after.count(data[i]) / total)
                break
            bits -= np.log2(len(set(after)) / total)
        else:
            bits += 8
    return bits


def test_languages_of_texts_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.identify(docs, remainder("doc_id", 5) != 0, rows_per_language=100).collect()
    assert len(out) == len(truth) and all(0 < r.score <= 1 for r in out)
    assert share_right([(r.lang_pred, truth[r.doc_id]) for r in out if held_out(r.doc_id, 5, 0)]) > 0.98


def test_languages_of_awkward_rows(spark):
    docs = rows.awkward(spark, lang_pred="x", score="y")
    out = langid.identify(docs, F.lit(True)).collect()
    assert len(out) == len(rows.DOCS)
    texts = [text for _, text, _ in rows.DOCS]
    assert sum(r.lang_pred == "und" for r in out) == sum(not t or not t.strip() for t in texts)
    assert langid.identify(rows.empty(spark), F.lit(True)).count() == 0
    unknown = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


@pytest.mark.parametrize(("method", "label", "modulus", "value"), [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_scores_of_texts_not_learned_from(spark, method, label, modulus, value):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    out = {r.doc_id: r.score for r in method.score(docs, labels, remainder("key", modulus) != value).collect()}
    assert len(out) == docs.count() and all(0 <= score <= 1 for score in out.values())
    known = {r.doc_id: r[label] for r in labels.collect()}
    pairs = [(out[k] >= 0.7, y == 1) for k, y in known.items() if held_out(k, modulus, value)]
    assert share_right(pairs) > 0.95
    assert share_right([p for p in pairs if p[1]]) > 0.8


@pytest.mark.parametrize(("method", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_awkward_rows(spark, method, label):
    docs = rows.awkward(spark, score="x", label="y", key="z")
    marked = rows.labels(spark, label, [(1, 1), (2, 0), (2, None), (None, 1), (3, 0), (5, 0), (5, 1), (7, 0), (99, 1)])
    out = method.score(docs, marked, F.lit(True)).collect()
    assert len(out) == len(rows.DOCS) and all(0 <= r.score <= 1 for r in out)
    assert method.score(rows.empty(spark), marked, F.lit(True)).count() == 0
    unlabelled = {r.score for r in method.score(docs, rows.no_labels(spark, label), F.lit(True)).collect()}
    assert len(unlabelled) == 1
    assert (unlabelled.pop() >= 0.7) == (label == "quality")  # nothing is rejected without labels


def test_clause_states():
    def state(text, at):
        return toxicity.clause_state(text.split(), at)

    assert state("what an idiot", 2) == "plain"
    assert state("you are an idiot", 3) == "aimed"
    assert state("this is not an idiot", 4) == "negated"
    assert state("not that it matters at all idiot", 6) == "plain"
    assert state("they said you idiot", 3) == "reported"


def test_a_quality_threshold_parts_the_labels():
    worth = np.array([-3.0, -2.5, -2.0, 1.0, 1.5, 2.0])
    cut = quality.parting_quantile(worth, np.array([0, 0, 0, 1, 1, 1]))
    assert -2.0 < cut < 1.0


def by_state(text, insults=None):
    found = toxicity.measures(text, toxicity.Lexicon(insults or {}))
    names = [*(f"weight {x}" for x in toxicity.STATES), *(f"clauses {x}" for x in toxicity.STATES), "total", "best", "density"]
    names += [*(f"threat weight {x}" for x in toxicity.STATES), *(f"threat clauses {x}" for x in toxicity.STATES)]
    return {name: np.expm1(x) for name, x in zip(names, found, strict=True)}


THREATENING = {"aimed": "I will kill you", "negated": "I will not kill", "reported": "he said kill", "plain": "kill the process"}


@pytest.mark.parametrize("state", toxicity.STATES)
@pytest.mark.parametrize("words", [0, 5000])
def test_threats_count_in_their_state(state, words):
    found = by_state(f"{'word. ' * words}{THREATENING[state]}.{' word.' * words}")
    for other in toxicity.STATES:
        assert found[f"threat clauses {other}"] == pytest.approx(float(other == state))
        assert found[f"threat weight {other}"] == pytest.approx(toxicity.THREAT * (other == state))
        assert found[f"clauses {other}"] == pytest.approx(float(other == state == "aimed"))
    assert found["best"] == pytest.approx(toxicity.THREAT * (state == "aimed"))


def test_a_clause_counts_all_its_matches():
    found = by_state("kill that idiot. " + "stone " * 50 + "idiot " + "stone " * 50 + "idiot you. he said kill, you idiot", {"idiot": 2.0})
    assert found["clauses plain"] == pytest.approx(2)
    assert (found["clauses aimed"], found["clauses reported"]) == (pytest.approx(1), pytest.approx(1))
    assert (found["threat clauses plain"], found["threat clauses reported"]) == (pytest.approx(1), pytest.approx(1))
    assert found["best"] == pytest.approx(4)


def test_scores_tell_threats_by_their_state(spark):
    filler = "the stone lies beside a river. " * 5
    docs, labels = [], []
    for key in range(400):
        state = toxicity.STATES[key % 4]
        text = filler * (1 + key % 7) + (THREATENING[state] + f" number{key}. " if key % 8 < 4 else "") + filler
        docs.append((key, text))
        labels.append((key, int(state == "aimed" and key % 8 < 4)))
    docs += [(1000 + k, filler * 300 + THREATENING[state] + ". " + filler) for k, state in enumerate(toxicity.STATES)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.score for r in toxicity.score(table, rows.labels(spark, "toxic", labels), F.lit(True)).collect()}
    assert [out[1000 + k] >= 0.7 for k in range(4)] == [state == "aimed" for state in toxicity.STATES]


def test_an_aimed_threat_is_scored_by_labels_without_threats(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    grammar = toxicity.learned(docs, labels, F.lit(True))
    long = " ".join(r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").limit(20).collect())
    texts = [(0, long), *((k + 1, f"{long} End. {THREATENING[state]}. {long}") for k, state in enumerate(toxicity.STATES))]
    scored = toxicity.with_toxicity(spark.createDataFrame(texts, "doc_id long, text string"), grammar).collect()
    out = {("none", *toxicity.STATES)[r.doc_id]: r.score for r in scored}
    assert out["aimed"] > 2 * max(out[state] for state in out if state != "aimed"), out


def test_the_quality_threshold_covers_all_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    learn = remainder("key", 4) != 2
    ranking = quality.learned(docs, labels, learn, rows=60)
    joined = docs.join(labels.where(remainder("doc_id", 4) != 2).where("quality IS NOT NULL"), "doc_id").collect()
    worth = ranking.worth(np.stack([quality.features(r.text or "") for r in joined]))
    y = np.array([r.quality for r in joined])
    cuts = np.unique(worth)
    cuts = np.sort(np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2]))
    wrong = [((worth >= cut) != (y == 1)).sum() for cut in cuts]
    assert len(y) > 200 and ((worth >= ranking.threshold) != (y == 1)).sum() == min(wrong)
    first = next(i for i, n in enumerate(wrong) if n == min(wrong))
    last = next((i for i in range(first, len(wrong)) if wrong[i] != min(wrong)), len(wrong)) - 1
    assert ranking.threshold == pytest.approx((cuts[first] + cuts[last]) / 2)
    assert ranking.scale == pytest.approx((np.quantile(worth[y == 1], 0.5, method="inverted_cdf") - np.quantile(worth[y == 0], 0.5, method="inverted_cdf")) / 8)
