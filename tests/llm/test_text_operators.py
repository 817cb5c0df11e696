import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontam, pii, quality, toxicity

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def passes(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m[0])]


@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "a", "12", "1.2.3.4", "300", " ", "-", "+", "+1 (017) 555-7713", "4539578763621486", "é", "0", "x.y@", "%"]), max_size=14).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_the_contracts(text):
    assert [s[:3] for s in pii.spans(text) if s.kind in pii.BASE] == brute_spans(text)


def test_added_spans_need_checksum_or_context():
    good, bad = "DE89370400440532013000", "DE88370400440532013000"
    assert [s.kind for s in pii.spans(f"to {good}.")] == ["iban"] and pii.spans(f"to {bad} x") == []
    assert pii.spans("n 078-05-1120 x") == [] and [s.kind for s in pii.spans("his ssn: 078-05-1120")] == ["national_id"]
    assert pii.spans(None) == pii.spans("") == []


def test_ibans_end_where_their_country_says():
    for text in ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "pay DE89 3704 0044 0532 0130 00 EUR 500", "GB82WEST12345698765432, FR14 2004 1010 0505 0001 3M02 606"):
        got = [text[s.start : s.end] for s in pii.spans(text) if s.kind == "iban"]
        assert got in (["DE89 3704 0044 0532 0130 00"], ["GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"])
    assert pii.spans("GB82WEST123456987654321 ZZ82 1234 1234 1234 1234") == []


def test_scores_move_added_spans_both_ways(monkeypatch):
    text = "his ssn: 078-05-1120 and 078-05-1121 " + "x" * 60 + " 078-05-1122"
    assert len(pii.spans(text)) == 2  # the last has no context
    monkeypatch.setattr(pii, "CONTEXT", 0.0)
    assert pii.spans(text) == []
    monkeypatch.setattr(pii, "KEEP", 0.2)
    assert len(pii.spans(text)) == 3


def test_many_spans_take_linear_time():
    import time

    for one in ("a@b.co 1.2.3.4 +1 (017) 555-7713 ", "call 555-123-4567 ", "tel 555-123-4567 ssn 078-05-1120 "):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            assert len(pii.spans(one * n)) >= n
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5


def test_added_spans_leave_out_overlaps():
    text = "tel 555-123-4567 0 call (555) 123-4567 bank DE89370400440532013000 tel +1 555-123-4567"
    kinds = [(s.kind, s.start, s.end) for s in pii.spans(text)]
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            assert a[2] <= b[1] or b[2] <= a[1]
    assert [k for k, *_ in kinds].count("iban") == 1


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 50_000):
        pii.spans(text)


def test_masking():
    assert pii.masked("mail a@b.co, ip 1.2.3.4 end") == "mail [EMAIL], ip [IP] end"
    assert pii.masked("") == "" and pii.masked(None) is None and pii.masked("none") == "none"


def test_digest(spark, docs):
    texts = [None, "", "a@b.co and +1 (017) 555-7713 é 1.2.3.4", "x" * 50_000]
    rows = {r.doc_id: r for r in pii.digest(docs(texts)).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[i].spans == base
    assert (rows[2].n_email, rows[2].n_ip, rows[2].n_card, rows[2].n_phone) == (1, 1, 0, 1)
    more = docs(texts + texts[2:3], [0, 1, None, 3, 2]).selectExpr("*", "1 AS spans", "2 AS n_email")
    assert [r.n_email for r in pii.digest(more).where("doc_id IS NULL OR doc_id = 2").collect()] == [1, 1]
    assert pii.digest(more.limit(0)).collect() == []
    out = pii.redacted(docs(texts))
    assert out.columns == docs(texts).columns and {r.doc_id: r.n_chars for r in out.collect()}[2] == len(pii.masked(texts[2]))


def _prose(rng, n, extra=()):
    w = [rng.choice(["ba", "co", "di", "fu"]) + rng.choice(["na", "re", "ti"]) + rng.choice(["", "s", "n", "ly"]) for _ in range(n)]
    for x in extra:
        w[rng.randrange(n)] = x
    return " ".join(w)


@pytest.fixture(scope="module")
def taught(spark, docs):
    rng = random.Random(11)
    bad = ["grob", "vile", "muck", "zonk"]
    y = [rng.random() < 0.3 for _ in range(400)]
    texts = [_prose(rng, 80, rng.sample(bad, 3) if t else ()) for t in y]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(y)] + [(1, 1, int(y[1])), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs(texts + [None, "", "grob vile muck"]), labels, y


def test_toxicity_held_out(taught):
    df, labels, y = taught
    rows = toxicity.classified(df, labels).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9
    last = {r.doc_id: r for r in rows}
    assert last[402].predicted == 1 and last[400].score == last[401].score


def test_toxicity_ignores_held_out_labels(spark, docs, taught):
    import zlib

    df, labels, y = taught
    flipped = spark.createDataFrame([(i, 1, int(t) if zlib.crc32(str(i).encode()) % 5 else 1 - int(t)) for i, t in enumerate(y)], "doc_id long, quality int, toxic int")
    a, b = toxicity.classified(df, labels).collect(), toxicity.classified(df, flipped).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_without_labels_every_text_is_alike(taught):
    df, labels, _ = taught
    assert len({r.score for r in toxicity.classified(df, labels.limit(0)).collect()}) == 1
    assert len({r.score for r in quality.classified(df, labels.limit(0)).collect()}) == 1
    assert toxicity.classified(df.limit(0), labels).collect() == quality.classified(df.limit(0), labels).collect() == []


def brute_models(texts, y):
    """P(c, word, history) of the docstring's formulas, and the vocabulary. None as a word is an unknown one."""
    from collections import Counter

    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for t, c in {(t, c) for t, c in zip(texts, y)}:
        w = toxicity.words(t)
        uni[c].update(set(w))
        bi[c].update(set(zip(w, w[1:])))
    n = [sum(u.values()) for u in uni]
    share = (n[1] + 1) / (sum(n) + 2)
    vocabulary, k = set(uni[0]) | set(uni[1]), Counter(b for _, b in set(bi[0]) | set(bi[1]))
    f = Counter(k.values())
    d = f[1] / (f[1] + 2 * f[2]) if f[1] else 0.5
    total = sum(k.values())
    shared = lambda w: max(0, k[w] - d) / total + d * len(k) / total / (len(vocabulary) + 1)
    kept = lambda m, e: max(0.0, m - e - toxicity.DISCOUNT * (e + 1) ** 0.5)
    a1 = [{w: kept(uni[c][w], (uni[0][w] + uni[1][w]) * (share if c else 1 - share)) for w in vocabulary} for c in (0, 1)]
    single = lambda c, w: a1[c].get(w, 0) / n[c] + (1 - sum(a1[c].values()) / n[c]) * shared(w)
    h = [Counter(), Counter()]
    for c in (0, 1):
        for (a, _), m in bi[c].items():
            h[c][a] += m
    a2 = [{}, {}]
    for a, b in set(bi[0]) | set(bi[1]):
        m, p = [bi[c][a, b] for c in (0, 1)], [h[c][a] * single(c, b) for c in (0, 1)]
        for c in (0, 1):
            if kept(m[c], sum(m) * p[c] / sum(p)) > 0:
                a2[c].setdefault(a, {})[b] = kept(m[c], sum(m) * p[c] / sum(p))

    def probability(c, w, before=None):
        own = a2[c].get(before, {})
        return single(c, w) if not own else own.get(w, 0) / h[c][before] + (1 - sum(own.values()) / h[c][before]) * single(c, w)

    return probability, vocabulary, a2


def test_both_models_sum_to_one_and_give_the_evidence(spark, docs):
    rng = random.Random(23)
    names = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("", "s", "t")]

    def text(bad):
        w = [rng.choice(names) for _ in range(25)]
        if bad:
            w[rng.randrange(20)] = "vile"
            w[22:24] = ["grim", "tide"]  # toxic only together
        elif rng.random() < 0.5:
            w[20:24] = ["grim", "ka", "high", "tide"]
        return " ".join(w)

    y = [i % 4 == 0 for i in range(600)]
    texts = [text(t) for t in y]
    df = docs(texts)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(y)], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled(df, labels, "toxic", toxicity.F.lit(True))
    table, base = toxicity.differences(toxicity.written(toxicity.counts_table(toxicity._count(df, rows)), "t"))
    model = toxicity.Model(table, base)
    p, vocabulary, pairs = brute_models(texts, map(int, y))
    assert "tide" in pairs[1]["grim"]
    for c in (0, 1):
        for before in (None, "ka", "grim", "vile", "high", "never"):
            assert abs(sum(p(c, w, before) for w in [*vocabulary, None]) - 1) < 1e-9
    for t in [*texts[:40], "grim tide", "high tide, grim ka", "an unknown vile", "", None]:
        w = toxicity.words(t)
        expect = sum(np.log(p(1, b if b in vocabulary else None, a) / p(0, b if b in vocabulary else None, a)) for a, b in zip([None, *w], w)) / (len(w) + toxicity.PRIOR_WORDS)
        assert abs(toxicity.evidence(t, model.odds, base) - expect) < 1e-9
    assert toxicity.evidence("grim tide", model.odds, base) > toxicity.evidence("high tide", model.odds, base)


def test_counting_reads_texts_once(spark, docs):
    df = docs(["a b c"] * 3)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3)], "doc_id long, quality int, toxic int")
    counts = toxicity.counts_table(toxicity._count(df, toxicity.written(toxicity.labelled(df, labels, "toxic", toxicity.F.lit(True)), "rows")))
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("MapInArrow") == 1


def test_toxicity_of_odd_rows(taught, docs):
    df, labels, y = taught
    odd = df.selectExpr("*", "'mine' AS toxic", "1 AS evidence", "2 AS toxic_score", "3 AS y", "4 AS key").unionAll(docs(["grob vile muck " * 30_000, "x", "x"], [None, 7000, 7000]).selectExpr("*", "'mine'", "1", "2", "3", "4"))
    rows = toxicity.classified(odd, labels).collect()
    assert len(rows) == 406 and all(isinstance(r.held_out, bool) for r in rows)
    assert [r.predicted for r in rows if r.doc_id is None] == [1] and len({r.score for r in rows if r.doc_id == 7000}) == 1


def test_quality_held_out(spark, docs):
    rng = random.Random(4)
    y = [i % 4 != 0 for i in range(400)]
    texts = [_prose(rng, 60) if t else rng.choice([_prose(rng, 40).upper().replace(" ", "!! "), " | ".join(_prose(rng, 30).split()), "De " * 90]) for t in y]
    labels = spark.createDataFrame([(i, int(t), 0) for i, t in enumerate(y)], "doc_id long, quality int, toxic int")
    rows = quality.classified(docs(texts), labels).collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = quality.Additive(x, y).scores(x)
    assert np.mean((p > 0.5) == y) > 0.9
    assert quality.Additive(np.zeros((0, 3)), np.zeros(0)).scores(x)[0] == 0.5


def brute_template(text):
    text = text or ""
    up, low = "A-ZÀ-ÖØ-ÞÑ", "a-zß-öø-ÿ"
    marked = re.sub(rf"(^|[.!?:;|\n][\"')\]]*)(\s*)(?=[{up}])", lambda m: f"{m[1]}{m[2]} \u0001", text)
    marked = re.sub(r"(?<=[0-9])[\s.,:/]+(?=[0-9])", "\u0002", marked)
    marked = re.sub(rf"(?<![^\W_])(?<!\u0001)([{up}][{low}][^\W_]*)[ -]+(?=[{up}][{low}])", lambda m: f"{m[1]}\u0002", marked)
    raw = [w for w in re.split(r"[^\w\u0001\u0002]+|_+", marked) if w]
    out = []
    for i, w in enumerate(raw):
        if "0" <= w[0] <= "9":
            out.append("<n>")
        elif i and "0" <= raw[i - 1][0] <= "9" and w.lower() in decontam.UNITS:
            out.append("<u>")
        elif w[0] != "\u0001" and w[0] != w[0].lower() and w[1:2] != w[1:2].upper():
            out.append("<p>")
        else:
            out.append(w.lower().lstrip("\u0001"))
    return raw, out


def brute_contaminated(texts, items):
    """(doc, item, windows, item windows, aligned)"""
    classes = {}
    for i, t in sorted(items.items()):
        classes.setdefault(tuple(brute_template(t)[0]), []).append(i)
    out = set()
    for d, t in texts.items():
        raw, words = brute_template(t)
        own = [w.lower().lstrip("\u0001") for w in raw]
        where = {}
        for a in range(len(words) - 4):
            where.setdefault(tuple(words[a : a + 5]), []).append(a)
        for key, ids in classes.items():
            iraw, iw = list(key), brute_template(items[ids[0]])[1]
            if not iw:
                continue
            if len(iw) < 5:
                low, n = [w.lower().lstrip("\u0001") for w in iraw], len(iw)
                if own == low or (n > 2 and any(own[a : a + n] == low for a in range(len(own)))):
                    out |= {(d, i, 1, 1, 1) for i in ids}
                continue
            plain = [p for p in range(len(iw) - 4) if sum(w[0] != "<" for w in iw[p : p + 5]) >= 2]
            useful = plain or list(range(len(iw) - 4))
            lines = {}
            for p in range(len(iw) - 4):
                for a in where.get(tuple(iw[p : p + 5]), ()):
                    same = all(iraw[q].lower() == raw[q + a - p].lower() for q in range(p, p + 5) if iw[q][0] == "<")
                    if p in plain or same:
                        lines.setdefault(a - p, {})[p] = same
            good = {}
            for shift, at in lines.items():
                strong = {p for p in at if p in useful}
                slots = {(iw[q], iraw[q].lower(), raw[q + shift].lower()) for p in strong for q in range(p, p + 5) if iw[q][0] == "<"}
                verbatim = {p for p, same in at.items() if same}
                run = any(set(range(p, p + 9)) <= verbatim for p in verbatim)
                consistent = len(slots) == len({s[:2] for s in slots})
                held = (strong if consistent else set()) | (verbatim if run else set())
                if held:
                    good[shift] = held
            n = len(set().union(*good.values())) if good else 0
            if n and (min(1, n / len(useful)) >= 0.8 or max(map(len, good.values())) >= 9):
                out |= {(d, i, n, len(useful), max(map(len, good.values()))) for i in ids}
    return out


def test_decontamination_matches_brute_force(spark, docs):
    rng = random.Random(8)
    items = {
        1: "If Anna buys 12 apples for 3 euros and then Anna sells 12 apples to Bob, how much has she left?",
        2: " ".join(_prose(rng, 40).split()), 3: "too few words", 4: None, 7: "If Anna buys 12 apples for 3 euros and then Anna sells 12 apples to Bob, how much has she left?",
        9: "the train goes 40 km in 2 hours over the long green bridge by the river", 10: "zebra", 11: "we saw how John paid 12 dollars for the old blue bicycle",
        12: "At 7 km 8 Oslo 9 m 10 Rome 11 ft", 13: "Übung macht den Meister",
    }
    same = items[1].replace("Anna", "Carl").replace("12", "55").replace("3 euros", "8 euros").replace("Bob", "Dora")
    broken = items[1].replace("12 apples to", "77 apples to").replace("then Anna", "then Zoe")
    texts = {
        0: _prose(rng, 30) + " . " + same + " " + _prose(rng, 20), 1: _prose(rng, 30) + ". " + broken, 2: "x " + items[2] + " y", 3: " ".join(items[2].split()[:13]), 4: " ".join(items[2].split()[:8]),
        5: None, 6: "", 7: _prose(rng, 300), 8: items[9].replace("40", "90").replace("km", "miles").replace("2", "5"), 9: "12 12 12 12 12 12 12 12 12", 10: "these are too few words, alas",
        11: "Zebra!", 12: "a zebra stood there", 13: "then we saw how Mary Jane Smith paid 1,250 dollars for the old blue bicycle", 14: "so: at 7 km 8 Oslo 9 m 10 Rome 11 ft.", 15: "so: at 7 km 8 Paris 9 m 10 Rome 12 ft.",
        16: "ja, Übung macht den Meister",
    }
    bench = spark.createDataFrame([*items.items(), (None, items[2])], "item_id long, text string")
    df = docs(list(texts.values()), list(texts)).selectExpr("*", "1 AS pos", "2 AS hash", "3 AS item_id", "4 AS filter", "5 AS raw", "6 AS class_id")
    got = {(r.doc_id, r.item_id, r.windows, r.item_windows, r.aligned) for r in decontam.contaminated(df, bench).collect()}
    assert got == brute_contaminated(texts, {k: v for k, v in items.items()})
    assert {g[:2] for g in got} == {(0, 1), (0, 7), (2, 2), (3, 2), (8, 9), (10, 3), (11, 10), (13, 11), (14, 12), (16, 13)}
    assert sorted(r.doc_id for r in decontam.cleaned(df, bench).collect()) == [1, 4, 5, 6, 7, 9, 12, 15]
    assert decontam.contaminated(df.limit(0), bench).collect() == [] == decontam.contaminated(df, bench.limit(0)).collect()


def test_a_full_filter_gives_the_same(spark, docs, monkeypatch):
    rng = random.Random(2)
    texts = [_prose(rng, 60) for _ in range(20)] + ["only three words"]
    bench = spark.createDataFrame([(i, t[:200]) for i, t in enumerate(texts)] + [(99, "only three words")], "item_id long, text string")
    whole = sorted(decontam.contaminated(docs(texts), bench).collect())
    monkeypatch.setattr(decontam, "FILTER_WORDS", 1)
    assert sorted(decontam.contaminated(docs(texts), bench).collect()) == whole and {r.item_id for r in whole} == {*range(21), 99}


def test_toxicity_counts_every_labelled_row(spark, docs, monkeypatch):
    rng = random.Random(17)
    y = [i % 3 == 0 for i in range(300)]
    texts = [_prose(rng, 20, ["grob"] if t else []) for t in y]
    df = docs([*texts, texts[0]])
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(y)] + [(300, 1, 1)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 40)  # 10 of each class are left out
    model = toxicity.fit(df, labels)
    assert model.odds["grob"] > 0.9 and len(model.odds) < 20
    whole = {r.doc_id: r.toxic_score for r in toxicity.scored(df, model).collect()}
    assert all(abs(whole[i] - model.score(t)) < 1e-12 for i, t in enumerate(texts))
    monkeypatch.setattr(toxicity, "ENTRIES", 0)  # joined, not sent
    joined = toxicity.fit(df, labels)
    assert joined.odds is None
    assert all(abs(r.toxic_score - whole[r.doc_id]) < 1e-9 for r in toxicity.scored(df, joined).collect())


def test_decontamination_keeps_a_verbatim_run_beside_a_changed_filling(spark, docs):
    rng = random.Random(31)
    words = _prose(rng, 60).split()
    words[5] = words[55] = "2"
    changed = [*words[:55], "7", *words[56:]]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = [(r.doc_id, r.aligned) for r in decontam.contaminated(docs([" ".join(changed), _prose(rng, 60)]), bench).collect()]
    assert [g[0] for g in got] == [0] and got[0][1] >= 50


def test_features_count_letters_of_any_script():
    f = lambda t: dict(zip(quality.FEATURES, quality.features(t)))
    plain = f("Это простое предложение на русском языке, и в нём нет ничего странного.")
    assert plain["ascii_share"] < 0.25 and plain["stops"] < 0.2 and plain["other_share"] == 0 and 0 < plain["upper_share"] < 0.1
    assert f("这是一个普通的句子，没有什么奇怪的。")["other_share"] == 0 and f("这是。")["last_stop"] == 1
    assert f("🙂🙂 ok")["other_share"] > 0.2 and f("a" * 100_000)["log_chars"] > 11
    assert f(None) == f("") == f(" \n ") and set(f(None).values()) == {0.0}


def test_quality_of_odd_rows_and_scores_by_hand(spark, docs):
    rng = random.Random(9)
    y = [i % 2 for i in range(120)]
    texts = [_prose(rng, 40) if t else "| # | " * 30 for t in y]
    df = docs([*texts, None, "", "é" * 50_000, texts[1], "x"], [*range(120), 500, 501, 502, 1, None]).selectExpr("*", "'mine' AS score", "7 AS predicted", "0 AS x", "1 AS y")
    labels = spark.createDataFrame([(i, t, 0) for i, t in enumerate(y)], "doc_id long, quality int, toxic int")
    rows = quality.classified(df, labels).collect()
    assert len(rows) == 125 and all(isinstance(r.held_out, bool) for r in rows)
    model = quality.fit(df, labels, quality.doc_crc() % 3 != 1)
    by = {}
    for t, i in zip([*texts, None, "", "é" * 50_000, texts[1], "x"], [*range(120), 500, 501, 502, 1, None]):
        by.setdefault(i, t)
    for r in rows:
        x, z = np.array(quality.features(by[r.doc_id])), model.base
        z += sum(table[(e <= v).sum()] for table, e, v in zip(model.tables, model.edges, x))
        z += sum(table[(model.coarse[i] <= x[i]).sum(), (model.coarse[j] <= x[j]).sum()] for i, j, table in model.pairs)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)
