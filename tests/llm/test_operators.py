"""The training-data operators on small inputs, against brute force, with nulls, repeats, empty tables and clashing columns."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import distinctive, language, leakage, near_duplicates, residue, sentences, term_trie

RECORDS = "record_id bigint, paragraphs array<string>"


def _runs(paragraphs):
    out = set()
    for p in paragraphs or []:
        t = (p or "").lower().split()
        out |= {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    return out


@pytest.fixture(scope="module")
def records(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        base = [draw.choice(words) for _ in range(draw.randint(4, 40))]
        for _ in range(draw.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2])):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((len(rows), [" ".join(own[: len(own) // 2]), None, " ".join(own[len(own) // 2 :])]))
    rows += [(1000, None), (1001, []), (1002, [""]), (1003, ["a b"]), (None, ["w1 w2 w3"])]
    rows += rows[:5]
    return spark.createDataFrame(rows, RECORDS)


def test_similar_pairs_equal_brute_force(records):
    sets = {r[0]: s for r in records.collect() if r[0] is not None and (s := _runs(r[1]))}
    for t in (0.6, 0.8, 0.3):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}
        got = [tuple(r) for r in near_duplicates.similar_pairs(records, t).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert near_duplicates.similar_pairs(records.limit(0)).count() == 0


def test_hot_runs_copies_and_several_abstracts(spark):
    """A third of all records are copies, all share runs, some have two abstracts; every chunk holds 4."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    common = "the same words stand in all of them"
    rows = [(k, [common + " and nothing else"]) for k in range(40)]
    rows += [(100 + k, [common, " ".join(draw.choice(words) for _ in range(draw.randint(3, 9)))]) for k in range(60)]
    rows += [(100 + k, [common]) for k in range(0, 60, 9)] + [(3, [common])] + [(200 + k, [common + " and nothing more"]) for k in range(9)]
    df = spark.createDataFrame(rows, RECORDS).withColumn("set", F.lit(1)).withColumn("id", F.lit("x"))
    held = {}
    for r, ps in rows:
        held.setdefault(r, []).append(_runs(ps))
    for t in (0.6, 0.8):
        alike = lambda a, b: any(x & y and len(x & y) >= t * len(x | y) - 1e-12 for x in held[a] for y in held[b])
        want = {(a, b) for a, b in itertools.combinations(sorted(held), 2) if alike(a, b)}
        got = [tuple(r) for r in near_duplicates.similar_pairs(df, t, hot=4).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 900
    classes = near_duplicates.record_classes(df, 0.8, hot=4).collect()
    assert Counter(r["class_id"] for r in classes)[0] == 40 and len(classes) == len({(r, str(s)) for r, many in held.items() for s in many if s})


def test_sketches_merge_in_a_tree(spark, monkeypatch):
    df = spark.createDataFrame([(k, [f"a b c d{k % 5} e"]) for k in range(200)], RECORDS).repartition(9)
    sets = near_duplicates.run_sets(df).select("runs")
    flat = near_duplicates.sketch(sets)
    monkeypatch.setattr(near_duplicates, "_FAN", 2)
    assert (near_duplicates.sketch(sets) == flat).all() and near_duplicates.sketch(sets.limit(0)).sum() == 0
    assert sorted(2.0 ** (flat[flat > 0] / 12.0) - 1)[-1] > 190


def test_term_counts(records, spark, monkeypatch):
    want, held, seen = Counter(), {}, set()
    rows = [tuple(r) for r in records.collect()] + [(0, ["w1 other words"]), (None, ["w2 w2"]), (None, ["w2 w3"])]
    for r, ps in rows:
        if (key := (r, str(ps))) not in seen:
            seen.add(key)
            t = [w for p in ps or [] for w in (p or "").split()]
            want.update(t)
            for w in t:
                held.setdefault(w, set()).add(r)
    df = spark.createDataFrame([(*r, 1) for r in rows], RECORDS + ", term int")
    for most, share in ((20, 1000), (100_000, 1000), (20, 3)):
        monkeypatch.setattr(term_trie, "routes", lambda subtrees, parts, share=share: _hot(subtrees, share))
        got = [(r["term"], r["total_frequency"], r["document_frequency"]) for r in term_trie.term_counts(df, limit=4, most=most).collect()]
        assert len(got) == len(want) and set(got) == {(w, want[w], len(held[w])) for w in want}
    assert term_trie.marked_counts(records.limit(0)).count() == 0


def _hot(subtrees, share):
    """The hot prefixes by brute force."""
    many: Counter = Counter()
    for r in subtrees.collect():
        for k in range(len(r["prefix"]) + 1):
            many[r["prefix"][:k]] += len(r["rests"])
    return {p for p, n in many.items() if n > share}


def test_hot_prefixes_are_lengthened(spark):
    df = spark.createDataFrame([(k, [f"abc{k} abd{k} x"]) for k in range(3000)], RECORDS)
    cells = df.select(F.lit("ab").alias("prefix"), F.array(F.concat(F.lit("c"), "record_id")).alias("rests"), F.array(F.lit(1)).alias("occurrences"), F.array(F.lit(1)).alias("records"))
    assert term_trie.routes(cells, 1) == {"", "a", "ab"} and term_trie.routes(cells.limit(500), 1) == set()
    got = term_trie.term_counts(df, limit=4).collect()
    assert len(got) == 6001 and {(r["total_frequency"], r["document_frequency"]) for r in got} == {(1, 1), (3000, 3000)}


def test_trie_bursts():
    draw, trie, want = random.Random(1), term_trie.BurstTrie(limit=3), Counter()
    for _ in range(2000):
        w = "".join(draw.choice("ab") for _ in range(draw.randint(0, 9)))
        trie.add(w, 1, 1)
        want[w] += 1
    assert {p + rest: c[0] for p, leaf in trie.leaves() for rest, c in leaf.items()} == want
    assert len(list(trie.leaves())) > 10


def test_distinctive(spark):
    word = "array<struct<text string, word_index int>>"
    rows = [("d1", 0, [("Alpha", 0), ("alpha", 1), ("beta", 2), (None, None), (" ", None)]), ("d2", 0, [("alpha", 0), ("beta", 1), ("7", 2)]), ("d3", 0, [("gamma", 0), ("7", 1)]), (None, 0, [("beta", 0)]), ("d4", 0, None)]
    df = spark.createDataFrame(rows + rows[:1], f"record string, part int, words {word}")
    got = {(r["record"], r["term"]): r["f"] for r in distinctive.distinctive_terms(df, distinctive.tf_idf, common=1).collect()}
    assert got == {("d1", "alpha"): 2, ("d1", "beta"): 1, ("d2", "alpha"): 1, ("d2", "beta"): 1}
    assert distinctive.distinctive_terms(df.limit(0), distinctive.log_entropy).count() == 0


def test_leaks_equal_brute_force(spark):
    draw = random.Random(3)
    words = [f"x{i}" for i in range(30)]
    item = [[draw.choice(words) for _ in range(draw.randint(5, 40))] for _ in range(12)]
    docs = []
    for k in range(40):
        t = [draw.choice(words) for _ in range(30)]
        src = draw.choice(item)
        n = draw.choice([0, 11, 12, 13, 20])
        docs.append((k, ", ".join(t + [w.upper() for w in src[:n]] + t[:5])))
    docs += [(100, None), (101, ""), (102, "x1 x2")]
    items = [(i, " ".join(w)) for i, w in enumerate(item)] + [(50, None), (51, "")]

    def windows(t):
        w = (t or "").lower().replace(",", "").split()
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs for i, q in items if windows(t) & windows(q)}
    d, q = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string")
    assert want and {tuple(r) for r in leakage.leaked_items(d, q).collect()} == want
    assert {tuple(r) for r in leakage.leaked_items(d, q, words_at_once=60).collect()} == want
    assert leakage.leaked_items(d, q.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), q).count() == 0


def test_whole_items_edited(spark):
    draw = random.Random(21)
    words = [f"y{i}" for i in range(400)]
    item = [[draw.choice(words) for _ in range(draw.randint(30, 110))] for _ in range(30)]
    docs = []
    for k in range(120):
        own = list(draw.choice(item))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            at = draw.randrange(len(own))
            own[at : at + draw.choice([0, 1, 1])] = [draw.choice(words)]
        filler = [draw.choice(words) for _ in range(draw.choice([0, 25, 200]))]
        cut = draw.randrange(len(filler) + 1)
        docs.append((k, " ".join(filler[:cut] + own + filler[cut:])))
    docs += [(500, None), (501, ""), (502, "y1 y2")]
    items = [(i, " ".join(w)) for i, w in enumerate(item)] + [(90, None), (91, "y1 y2")]
    whole = leakage.WholeItems([i for i, _ in items], [np.array([hash(w) & (2**64 - 1) for w in (t or "").split()], np.uint64) for _, t in items], 5, 14)
    want = set()
    for d, t in docs:
        s = leakage.shingles(np.array([hash(w) & (2**64 - 1) for w in (t or "").split()], np.uint64), 5)
        for k, (i, _) in enumerate(items):
            n = min(len(whole.sets[k]), len(s))
            if n and any(whole.similarity(k, s[b : b + n]) >= 0.8 for b in range(len(s) - n + 1)):
                want.add((d, i))
    d, q = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string")
    got = {tuple(r) for r in leakage.near_items(d, q, words_at_once=1000).collect()}
    assert len(want) > 60 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 1
    assert leakage.near_items(d, q.limit(0)).count() == 0 and leakage.near_items(d.limit(0), q).count() == 0


SENTENCES = [
    "Patients received {} in March.",
    "The dose rose to 4.5 mg within days.",
    "Dr. {} and Prof. {} read all charts.",
    "Costs fell from 3.1 to 2.4 in the U.S. and in {}.",
    "The protocol (No. 58) was approved before enrolment.",
    'One nurse said, "It hurts. Then it stops."',
    "Most adults stayed in {}.",
    "See Fig. 3 for details.",
    "Adverse events, e.g. nausea, were rare with {}.",
    "Evidence was low.",
    "Larger trials should follow.",
]
NAMES = ["Kelvar", "Tamby", "Ostwick", "Brasen", "Merova", "Zelard"]


@pytest.fixture(scope="module")
def model():
    draw = random.Random(2)
    return sentences.train([" ".join(draw.choice(SENTENCES) for _ in range(draw.randint(1, 6))).replace("{}", draw.choice(NAMES)) for _ in range(500)])


def test_sentence_ranges(spark, model):
    parts = [s.replace("{}", "Tamby") for s in SENTENCES]
    text = " ".join(parts)
    cut = [text[a:b] for a, b in sentences.split(text, model)]
    assert cut == parts
    rows = [("a", 0, text), ("a", 0, text), ("b", 1, None), ("c", 2, ""), ("d", 3, "  \n"), ("e", 4, "no end"), ("f", 5, "これは一つ。それは二つ！"), ("g", 6, "x " * 50_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "k string, n int, text string, char_start_ string")
    got = sentences.sentence_ranges(df, ["k", "n"], model).collect()
    assert Counter(r["k"] for r in got) == {"a": len(cut), "e": 1, "f": 2, "g": 1}
    for r in got:
        t = next(t for k, _, t in rows if k == r["k"])
        piece = t[r["char_start"] : r["char_end"]]
        assert piece == piece.strip() != ""


def test_stretches_without_marks(model):
    parts = [s.replace("{}", "Tamby").rstrip(".") for s in SENTENCES if '"' not in s and "(" not in s and "U.S" not in s and "Fig" not in s and "e.g" not in s and "Dr" not in s]
    draw = random.Random(12)
    right = total = made = 0
    for _ in range(20):
        row = [draw.choice(parts) for _ in range(14)]
        text = " ".join(row)
        ends = {sum(map(len, row[:k])) + k - 1 for k in range(1, 14)}
        got = {b for _, b in sentences.split(text, model)[:-1]}
        right, total, made = right + len(ends & got), total + len(ends), made + len(got)
    assert right >= 0.9 * total and right >= 0.9 * made
    # A stretch no longer than sentences are is left alone, and so is one in which nothing tells one place from another.
    assert len(sentences.split(parts[0], model)) == 1 and len(sentences.split("x " * 3000, model)) == 1


def test_the_model_counts_every_paragraph(spark):
    """More paragraphs than the 6,000 once drawn: the fit equals the training on all of them, in any order, copies once."""
    draw = random.Random(14)
    texts = [f"Site {k} was open. " + " ".join(draw.choice(SENTENCES) for _ in range(2)).replace("{}", draw.choice(NAMES)) for k in range(6_500)]
    texts += [f"{k}. 结果很好。他们来了！" for k in range(20)] + ["no end", "(One. Two.) Three", "ab \n"]
    rows = [(t,) for t in texts] + [(texts[0],), (None,), ("",), ("  ",)]
    got, want = sentences.fit(spark.createDataFrame(rows, "text string").repartition(5)), sentences.train(texts[::-1])
    assert got.vocabulary == want.vocabulary and got.event == want.event and got.next == want.next
    assert got.event["low .",][1] > 6_500 and (got.bare.left, got.bare.right, got.bare.longest) == (want.bare.left, want.bare.right, want.bare.longest)
    empty = sentences.fit(spark.createDataFrame([(None,)], "text string"))
    assert len(sentences.split("One here. Two there.", empty)) in (1, 2)


def test_paragraphs_are_judged_once_and_pairs_counted_once(spark, monkeypatch):
    """Ends judged for the model are those of the sentences; only the last round counts pairs, and those too rare to tell anything are not held."""
    draw = random.Random(16)
    texts = [" ".join(draw.choice(SENTENCES) for _ in range(draw.randint(1, 5))).replace("{}", draw.choice(NAMES)) for _ in range(300)]
    texts += [" ".join(s.rstrip(".").replace("{}", "Tamby") for s in draw.choices(SENTENCES[-2:], k=14)), "これは一つ。それは二つ！", "no end", "\n", " ", None, ""]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 1, t) for k, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "k int, text string").repartition(4)
    fitted, found = sentences._fitted(df)
    distinct = {t for t in texts if t and t.strip(" ")}
    ends = [(r["text"], r["char_ends"]) for r in found.collect()]
    assert len(ends) == len(distinct) and dict(ends) == {t: sentences.judged(t, fitted) for t in distinct}
    want = Counter((k, a, b) for k, t in set(rows) if t in distinct for a, b in sentences.split(t, fitted))
    assert Counter(map(tuple, sentences.sentence_ranges(df, ["k"]).collect())) == want
    told, tell = [], sentences.Sums.told
    monkeypatch.setattr(sentences.Sums, "told", lambda self: told.append(tell(self)) or told[-1])
    model = sentences.train(list(distinct))
    assert [any(kind == "pair" or key.endswith("\x1fpair") for kind, key in sums) for sums in told] == [False, False, False, True]
    pairs = {key: n for key, (_, n) in model.event.items() if len(key) == 3}
    assert pairs and min(pairs.values()) >= 3 and (model.event, model.next) == (fitted.event, fitted.next)


def test_words_of_sentences_are_counted_once_for_both_sides():
    """Every place between two words of a text counts what stands before it and behind it, also where a text mixes scripts."""
    bare, left, right = sentences.Bare(), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for parts in (["One dose rose.", "One fell!", "rose"], ["One"], ["One fell.", "他们 One fell。", "One dose."], ["他们 rose。", "One dose"]):
        text, ranges, rows = " ".join(parts), [], []
        for part in parts:
            a = ranges[-1][1] + 1 if ranges else 0
            ranges.append((a, a + len(part)))
            rows.append(part.rstrip("!.。").replace("他们", "他 们").split())
        bare.learn(text, ranges)
        units = [(w, k) for k, row in enumerate(rows) for w in row]
        for (w, k), (v, n) in zip(units, units[1:]):
            for side, unit in ((left, w), (right, v)):
                for context in (0, "=" + unit.lower()):
                    side[context][0] += k != n
                    side[context][1] += 1
    assert bare.units["words"]["One"] == 6 and not bare.units["before"]["dose"]
    bare.told()
    for got, want in ((bare.left, left), (bare.right, right)):
        words = [k for k in want if k not in ("=他", "=们")]  # characters have other contexts
        assert len(words) >= 4 and all(got[k] == want[k] for k in words)


def test_a_pair_seen_often_is_not_what_it_was_first_taken_for():
    """A sentence that begins in lower case is first taken for none; the more often it stands behind the same word, the surer it stayed so."""
    draw = random.Random(15)
    after = ["mRNA levels fell.", "The dose rose.", "Costs fell.", "Evidence was low.", "Larger trials followed."]
    every = [*after, "All stayed for 12 weeks.", "Some came at 3 p.m. on Mondays."]
    texts = [" ".join(draw.choice(every) for _ in range(draw.randint(1, 6))) for _ in range(1500)]
    model = sentences.train(texts)
    assert [len(sentences.split(f"All stayed for 12 weeks. {x}", model)) for x in after] == [2] * 5


def test_long_quotations_stay_whole(model):
    inner = "It hurts. Then it stops. " * 60
    text = f'Costs rose. One nurse said, "{inner.strip()}" Evidence was low.'
    cut = [text[a:b] for a, b in sentences.split(text, model)]
    assert len(cut) == 3 and cut[1].startswith("One nurse") and cut[1].endswith('stops."')
    assert len(sentences.split("Evidence was low." + " " * 500 + "Costs rose.", model)) == 2


def test_gaps_are_found_where_plain_alternatives_find_them():
    """The patterns that begin with a set of characters, against the alternatives they stand for."""
    end, shut, thai, han = ".!?…。！？।॥", "\"'”’»)\\]）」』》", "฀-๿", "぀-ヿ㐀-鿿豈-﫿"
    plain = re.compile(
        rf"[。！？।॥]+[{shut}]*|[{end}]+(?:\s*»|[{shut}])*(?=\s|[\"'“‘„«(\[（「『《¿¡]|[^\W\d_a-z]|[{han}])|(?<=[^\W\d]{{3}})[.!?](?=\d)|(?<=[{thai}])\s+(?=[{thai}])|(?<=\))\s+(?=\()"
        rf"|(?<=[{thai}])\s+(?=(?:[^\s{thai}]+\s+){{3}}[^\s{thai}]|[^\s{thai}]*[{han}ऀ-ॿЀ-ӿ])"
    )
    draw = random.Random(18)
    for _ in range(20_000):
        text = "".join(draw.choice("abcA1.!…。।»”)(กж中 \n") for _ in range(draw.randint(1, 30)))
        pattern = sentences._GAP_AT_MARK if sentences._GAP_AT_BLANK.search(text) is None else sentences._GAP
        assert [m.span() for m in pattern.finditer(text)] == [m.span() for m in plain.finditer(text)], text


def test_sides_of_gaps_are_weighed_once_and_usual_sentences_not_cut_into_units(model, monkeypatch):
    texts = [f"{a} {b}" for a in SENTENCES for b in SENTENCES for _ in range(2)]
    want = [sentences.split(t, model) for t in texts]
    model.forget()
    lefts, units = [], []
    left, cut = sentences.EventModel.left, sentences._units
    monkeypatch.setattr(sentences.EventModel, "left", lambda self, contexts, full: lefts.append(contexts[0]) or left(self, contexts, full))
    monkeypatch.setattr(sentences, "_units", lambda text: units.append(text) or cut(text))
    assert [sentences.split(t, model) for t in texts] == want
    gaps = [g for t in texts for g in sentences.gaps(t)]
    assert len(lefts) <= len({(g.l2, g.l1) for g in gaps} | {("<s>", g.l1) for g in gaps}) < len({(g.l2, g.l1, g.r1, g.r2) for g in gaps})
    assert not units
    long = "x " * 3000
    assert len(sentences.split(long, model)) == 1 and units


ENGLISH = ["The patients were treated with care and the dose was raised over the weeks.", "We searched several databases for trials of the drug in adults with the disease."]
FRENCH = ["Les patients ont été suivis pendant plusieurs semaines dans les hôpitaux de la ville.", "Il reste à savoir si le traitement modifie durablement le poids chez les adultes."]


def test_languages(spark):
    draw = random.Random(4)
    rows = [(k, "en" if k % 9 else "fr", [" ".join(draw.sample([*ENGLISH, f"Site {k} was open."], 3))]) for k in range(60)]
    rows += [(100 + k, "fr", [" ".join(draw.sample([*FRENCH, f"Le centre {k} est ouvert."], 3))]) for k in range(40)]
    rows += [(200, "und", [ENGLISH[0] + " " + FRENCH[0], None, ""]), (201, None, ["Это русский текст о лечении."]), (202, "ru", None), (203, None, []), (204, None, [" "]), (205, "RU_ru", ["Это русский текст."])]
    df = spark.createDataFrame(rows + rows[:3], "record_id bigint, label string, paragraphs array<string>")
    got = {(r["record_id"], r["paragraph_no"], r["char_start"]): r["lang"] for r in language.corrected_languages(df).collect()}
    assert got.pop((201, -1, 0)) == "ru" and (205, -1, 0) not in got
    assert got.pop((200, 0, 0)) == "en" and got.pop((200, 0, len(ENGLISH[0]) + 1)) == "fr"
    got.pop((200, -1, 0))
    assert got == {(k, -1, 0): "en" for k in range(0, 60, 9)}
    assert [language.named(x) for x in ("EN-us", "ger", "French ", "mul", "en;de", None)] == ["en", "de", "fr", None, None, None]


def test_every_record_and_stretch_has_a_language_and_a_confidence(spark):
    draw = random.Random(16)
    rows = [(k, "en", [" ".join(draw.sample([*ENGLISH, f"Site {k} was open."], 3)), None, ENGLISH[1]]) for k in range(40)]
    rows += [(100 + k, "fr", [" ".join(draw.sample([*FRENCH, f"Le centre {k} est ouvert."], 3))]) for k in range(40)]
    rows += [(200, "en", None), (201, "en", [" "]), (202, "fr", [ENGLISH[0]])]
    df = spark.createDataFrame(rows + rows[:2], "record_id bigint, label string, paragraphs array<string>")
    got = {(r["record_id"], r["paragraph_no"], r["char_start"]): r for r in language.languages(df).collect()}
    assert set(got) == {(k, n, 0) for k in range(40) for n in (-1, 0, 2)} | {(100 + k, n, 0) for k in range(40) for n in (-1, 0)} | {(202, -1, 0), (202, 0, 0)}
    assert all(r["lang"] == ("fr" if 100 <= r["record_id"] < 200 else "en") and 0 < r["confidence"] <= 1 for r in got.values())
    assert {k for k, r in got.items() if r["corrects"]} == {(202, -1, 0)} == {(r["record_id"], r["paragraph_no"], r["char_start"]) for r in language.corrected_languages(df).collect()}


def test_stretches_are_whole_sentences_that_rough_pieces_hide():
    """A French sentence in lower case after an English one: both lie in one rough piece."""
    draw = random.Random(17)
    every = [*ENGLISH, *FRENCH, "mRNA levels fell.", "Costs fell.", "The dose rose."]
    model = sentences.train([" ".join(draw.choice(every) for _ in range(draw.randint(1, 6))) for _ in range(800)])
    compressors = language.Compressors({"en": " ".join(ENGLISH * 3).encode(), "fr": " ".join(FRENCH * 3).encode()})
    text = ENGLISH[0] + " mRNA " + FRENCH[0][4:]
    assert len(language.rough_pieces([text])) == 1
    assert [(k, a, c) for k, a, _, c, _ in language.stretches([text], compressors, model)] == [(0, 0, "en"), (0, len(ENGLISH[0]) + 1, "fr")]


def test_unknown_languages_are_rejected(spark):
    draw = random.Random(6)
    rows = [(k, "en", [" ".join(draw.sample([*ENGLISH, f"Site {k} was open."], 3))]) for k in range(40)]
    rows += [(100 + k, "fr", [" ".join(draw.sample([*FRENCH, f"Le centre {k} est ouvert."], 3))]) for k in range(40)]
    rows += [(300, "xx", ["Obat itu menolong beberapa orang tua untuk tidur nyenyak setiap malam."]), (301, "xx", [ENGLISH[0]])]
    df = spark.createDataFrame(rows, "record_id bigint, label string, paragraphs array<string>")
    got = {r["record_id"]: r["rejected"] for r in language.corrected_languages(df).collect() if r["paragraph_no"] == -1}
    assert got == {300: True, 301: False}


def test_pieces_tried_against_all_others_change_nothing():
    draw = random.Random(8)
    words = {c: [f"{a}{b}{e}" for a in ("ka", "lo", "mi", "tu") for b in x for e in y] for c, x, y in (("en", "ptk", ("ing", "ed")), ("fr", "vzl", ("ait", "eux")), ("de", "gbd", ("ung", "ig")), ("es", "rsc", ("ado", "mos")), ("pt", "nmf", ("ções", "inho")))}
    text = {c: [" ".join(draw.choice(w) for _ in range(draw.randint(6, 14))).capitalize() + ". " for _ in range(400)] for c, w in words.items()}
    compressors = language.Compressors({c: "".join(t[:300]).encode() for c, t in text.items()})
    for _ in range(60):
        record = ["".join(draw.choice(text[draw.choice(["en", "fr", "en", "de"])][300:]) for _ in range(draw.randint(1, 9)))]
        pieces = language.rough_pieces(record)
        quick, whole = language.path(record, pieces, compressors), language.path(record, pieces, compressors, True)
        assert [c for c, _, _ in quick] == [c for c, _, _ in whole]


def test_no_piece_is_sized_twice_under_a_language():
    compressors = language.Compressors({"en": " ".join(ENGLISH * 3).encode(), "fr": " ".join(FRENCH * 3).encode()})
    # The second sentence is in neither language, so that trying English against all others does not tell.
    record = [ENGLISH[0] + " Obat itu menolong beberapa orang tua setiap malam. " + ENGLISH[1]]
    pieces = language.rough_pieces(record)
    assert len(pieces) == 3
    want = language.path(record, pieces, compressors)
    sized = []
    for code, compress in list(compressors.ready.items()):
        compressors.ready[code] = lambda raw, code=code, compress=compress: sized.append((code, raw)) or compress(raw)
    assert language.path(record, pieces, compressors) == want
    assert len(sized) == len(set(sized)) and ("en", pieces_text(record, pieces[1])) in sized


def pieces_text(record, piece):
    return record[piece.paragraph][piece.start : piece.end].encode()


def test_every_label_reaches_the_sentence_model(spark):
    rows = [(k, "en", [f"Site {k} was open. Visitors came."]) for k in range(60)] + [(100 + k, "hi", [f"केंद्र {k} खुला था। लोग आए।"]) for k in range(20)] + [(200 + k, "th", [f"ศูนย์ที่ {k} เปิดแล้ว ผู้ป่วยมาถึงแล้ว"]) for k in range(20)]
    df = spark.createDataFrame(rows, "record_id bigint, label string, paragraphs array<string>")
    _, model = language.fit(df, sample=100)
    assert {"hindi ।", "thai", "low ."} <= {c[0] for c in model.event if len(c) == 1}
    # The dictionaries stop at a size: the order must not follow the labels.
    labels = [r[0] for r in sentences.drawn(df.select("label", "paragraphs"), 100)]
    assert len(labels) == 100 and all(set(labels[a : a + 50]) == {"en", "hi", "th"} for a in (0, 50))


def test_copies_are_drawn_once(spark):
    df = spark.createDataFrame([("copy",)] * 1000 + [(f"text {k}",) for k in range(50)], "text string")
    assert sorted(sentences.drawn(df, 60)) == sorted([("copy",), *((f"text {k}",) for k in range(50))])


def test_residue(spark):
    good = ["Doses [mg] are given as <mean> values.", "The set {IL-6, TNF} was measured with ${\\beta}_0$ free.", "A placeholder device replaced the pen.", "Of 9 links 4% returned a 404 Not Found error when checked.", "Readers found lorem ipsum pages harder.", None, "", "  "]
    bad = ["Text {{title}} text.", "Rose by ${doi} in all.", "[INSERT TITLE HERE]", "Lorem ipsum dolor sit amet consectetur elit", "Please enable JavaScript to view this article.", "HTTP/1.1 503 Service Unavailable\nretry-after: 30", "Your session has expired. Please log in again.", "TODO: write the abstract section.", "Real words here. Access denied. You do not have permission to view this."]
    rows = [(i, t, None, None, "h") for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc bigint, text string, title string, slug string, host string")
    assert {r["doc"] for r in residue.residue(df).collect()} == set(range(len(good), len(good) + len(bad)))
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.residue(df.withColumn("host", F.lit(None).cast("string"))).count() == len(bad)
