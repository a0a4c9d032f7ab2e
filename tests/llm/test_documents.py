"""Operators that read one document at a time, against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from edgestream.llm import decontamination, language_id, license_scan, quality_rules, token_counts, toxicity, url_filters

from .helpers import alnum, awkward, empty, frame, words


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- quality -----------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_base_counts(spark):
    docs = awkward(spark)
    found = quality_rules.quality(docs).collect()
    assert len(found) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        expected = plain_quality(texts[r.doc_id])
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == expected
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_quality_frequent_lines(spark):
    notice = "this page uses cookies so please accept all of them before you go on reading anything here at all"
    texts = [f"{notice}\nown{i} text{i}" for i in range(12)] + [f"{notice}\n" + " ".join(f"w{i}_{k}" for k in range(60)) for i in range(3)]
    sources = ["a"] * 12 + ["a", "b", None]
    measured = quality_rules.measure(frame(spark, texts, sources=sources))
    got = {r.doc_id: (r.n_removed, r.kept) for r in quality_rules.judge(measured, least=10, percent=0).collect()}
    n = len(words(notice))
    assert got[0] == (n, False) and got[12] == (n, True)
    assert got[13] == (0, True) and got[14] == (0, True)  # other hosts
    copies = quality_rules.measure(frame(spark, [texts[0]] * 30, sources=["a"] * 30))
    assert quality_rules.judge(copies, least=10, percent=0).where("n_removed > 0").count() == 0  # copies are one text


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_quality_stage_removes_frequent_lines(spark, most_broadcast):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    notice = "Please  accept all cookies before you read on"
    texts = [f"{notice.upper() if i % 2 else notice}\n{body(i)}\n\n{notice}" for i in range(9)] + [f"{notice}\n{body(90)}", "\n".join([notice] * 3 + ["own words"]), body(91), None]
    sources = ["a"] * 9 + ["b", "a", "a", None]
    docs = frame(spark, texts, sources=sources)
    docs = docs.unionAll(docs.where("doc_id = 0"))
    got = sorted((r.doc_id, r.text) for r in quality_rules.keep_good(docs, most_broadcast=most_broadcast, least=5, percent=1).collect())
    expected = [(i, f"{body(i)}\n") for i in (0, *range(9))] + [(9, texts[9]), (11, texts[11])]
    assert got == expected  # 10 is depleted; host b has its own count
    judged = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.quality(docs).collect()}
    assert judged[10] == (False, False) or judged[10][0]
    # a line must also reach a share of its host's texts
    assert quality_rules.judge(quality_rules.measure(docs), least=5, percent=99).where("n_removed > 0").count() == 0


def test_quality_stage_keeps_rows_and_columns(spark):
    good = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [good, "short", None, good])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3]
    assert quality_rules.quality(empty(spark)).count() == 0 and quality_rules.keep_good(empty(spark)).count() == 0


# --- decontamination ---------------------------------------------------------------------------


def plain_contamination(text, items):
    w = alnum(text)
    hit, found = set(), set()
    for k, t in items:
        v = alnum(t)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_decontamination(spark, monkeypatch, most):
    # most = 1: an item a block, a block a pass
    monkeypatch.setattr(decontamination, "passes", lambda b, w, *_, f=decontamination.passes: f(b, w, most, most))
    passage = " ".join(f"q{i}" for i in range(14))
    items = [(1, passage), (2, "Short Item"), (3, None), (4, "!!"), (11, f"other {passage} end"), (5, "a b c d e f g h a b")]
    texts = [f"Intro, {passage.upper()}! outro", "a short-item here short item", passage[:20], None, "", "a b c d e f g h a b c d e f g h a b", "é short é item"]
    docs = frame(spark, texts).unionAll(awkward(spark).withColumn("doc_id", __import__("pyspark").sql.functions.expr("doc_id + 100")))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in decontamination.decontaminate(docs, benchmark).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain_contamination(source[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0)
    left = decontamination.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and not {0, 1, 5} & {r.doc_id for r in left.collect()}
    assert decontamination.decontaminate(empty(spark), benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_phrase_and_proximity(spark):
    docs = frame(spark, ["red green blue", "blue x red y green", "red green", "Red, Green! BLUE red green blue"])
    phrases = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    exact = {(int(r.doc_id), r.first_word, r.last_word) for r in decontamination.matches(docs, phrases).collect()}
    assert exact == {(0, 0, 2), (3, 0, 2), (3, 3, 5)}
    near = {int(r.doc_id) for r in decontamination.matches(docs, phrases, within=5).collect()}
    assert near == {0, 1, 3}


# --- licenses ----------------------------------------------------------------------------------


def test_license_base(spark):
    texts = ["Released under the MIT License. mit-license!", "The Apache  license", "GNU General Public License, version 3", "mit licenses", "Admit license", None, "nothing"]
    got = by_id(license_scan.scan(frame(spark, texts)))
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 3, 5, "mit")
    assert got[1].base_labels == "apache" and got[2].base_labels == "gpl" and "gpl-3.0" in got[2].labels
    assert got[3].n_base == 0 and got[4].n_base == 0 and got[3].first_word is None
    assert (got[5].n_words, got[5].labels, got[5].score) == (0, "", 0.0) and got[6].score == 0.0
    assert license_scan.scan(awkward(spark)).count() == 12 and license_scan.scan(empty(spark)).count() == 0


def test_license_rules_compile_and_suppress():
    assert len(license_scan.all_rules()) > 200
    labels = lambda t: [d["label"] for d in license_scan.scan_text(t)["detections"]]
    assert labels("licensed under the Apache License, Version 2.0") == ["apache-2.0"]
    assert labels("Licensed under CC BY-NC 4.0") == ["cc-by-nc"]
    assert labels("GNU Lesser General Public License version 3") == ["lgpl-3.0"]
    assert labels("apache helicopter") == []
    assert labels("in no event will the authors be held liable for any damages arising from the use of this software") == ["zlib"]
    assert labels("Creativecommons.org/licenses/by-nc-sa/4.0") == ["cc-by-nc-sa"]


def test_a_rule_cannot_match_without_its_keyword():
    import re

    alike = lambda t: t.replace("license", "licens").replace("licence", "licens")
    for r in license_scan.all_rules():
        plain = re.sub(r"\(\?[!<].*?\)", "", r.pattern).replace("[sc]", "s")
        while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", plain)) != plain:  # optional parts may be missing
            plain = shorter
        assert alike(r.keyword) in alike(re.sub(r"[a-z0-9 +]\?", "", plain)), r


def plain_suppress(found):
    kept = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end and (k.start, k.end, k.priority) != (d.start, d.end, d.priority) for k in kept):
            kept.append(d)
    return sorted(kept)


def test_suppression_equals_the_plain_one():
    draw = __import__("random").Random(4)
    for _ in range(400):
        found = [license_scan.Detection(a := draw.randrange(30), a + draw.randrange(1, 12), draw.randrange(3), draw.choice("ab")) for _ in range(draw.randrange(25))]
        assert license_scan.suppress(found) == plain_suppress(found)


def test_license_base_columns_against_brute_force(spark):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    draw = __import__("random").Random(6)
    vocabulary = ["mit", "MIT", "license", "License", "apache", "general", "public", "x", "é", "licenses"]
    texts = ["".join(draw.choice(vocabulary) + draw.choice([" ", "-", "\n", ". "]) for _ in range(draw.randrange(60))) for _ in range(60)] + ["released under the mit license " * 2000]
    docs = frame(spark, texts).unionAll(awkward(spark).selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "lines", "host", "row", "rid", "size"))
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        w = alnum(source[r.doc_id])
        places = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(base))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


# --- URLs --------------------------------------------------------------------------------------


def test_url_filters(spark):
    urls = ["http://A.example.NET/en/1?x", "https://example.net/de/", "https://example.net", "http://example.com/de/x#f", "http://shop.org/fr/", "http://notorg/fr/", "https://cheap-pills.example.com/en/", None, "no scheme", "ftp://x.net?q=/en/", "http://a://b.net/"]
    pages = spark.createDataFrame([(i, u, "h", "u", "c") for i, u in enumerate(urls)], "page_id long, url string, host string, _url string, _candidates string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/", "net/", "block")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][2:] == (None, "allow") and got[6][2:] == (None, "block")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("x.net", "", None, "allow") and got[10] == ("a:", "//b.net/", None, "allow")
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_url_rules_of_a_table_answer_like_those_of_the_plan(spark, monkeypatch):
    long_url = "http://example.net/en/" + "/".join(f"part{k}" for k in range(20_000)) + "/login"
    urls = ["http://A.example.NET/en/1?x", "https://cheap-pills.example.com/en/", "http://a.com/login?x", "http://a.com/?jsessionid=3", "http://10.2.3.4/x", "http://a.com/blogin", long_url, None, "", "http://a.org/fr/x", "http://casino-poker.com/free-warez"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r) for r in url_filters.filter_urls(pages).collect()}
    assert [got[i][4] for i in (1, 2, 3, 4, 5)] == ["block", "block", "block", "block", "allow"] and len(got) == 22
    monkeypatch.setattr(url_filters, "MOST_RULES", 3)
    assert {r.page_id: tuple(r) for r in url_filters.filter_urls(pages).collect()} == got
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


# --- token counts ------------------------------------------------------------------------------


def test_token_counts_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello's 'st IT'LL we're 12345 <|endoftext|> x", "ΑΣ ΣΑΣ. İstanbul é é \u0085x\x1cy aaaaaaa a", "日本語テキスト 😀😀 <|STARTOFTEXT|>", "ᾼ ß ﬁ ǅ ẞ", "<|startoftext|>" * 3, "a" * 5000]
    docs = frame(spark, texts).unionAll(awkward(spark).selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "lines", "host", "row", "rid", "size"))
    library = tokenizers.Tokenizer.from_file(token_counts.default_path())
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_counts.count_tokens(docs).collect():
        text = source[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.count_tokens(empty(spark)).count() == 0


# --- language and toxicity ---------------------------------------------------------------------

EN, DE = "the cat and the dog went with them to the house because of this", "der hund und die katze sind nicht mit dem haus weil das hier ist"


def test_language_spans_and_scripts(spark):
    texts = [EN, DE] * 20 + ["Это русский текст о том как мы"] * 10
    docs = frame(spark, texts, langs=["en", "de"] * 20 + ["ru"] * 10)
    model = language_id.learn(docs)
    assert model.languages == ["de", "en", "ru"]
    mixed = f"{EN} {EN} {DE} {DE} {DE}"
    probe = frame(spark, [EN, DE, "русский как", mixed, "", None, "12 34", "日本"])
    got = by_id(language_id.identify(probe, model).select("row.doc_id", "lang_pred", "score", "spans"))
    assert [got[i].lang_pred for i in range(3)] == ["en", "de", "ru"]
    assert got[3].lang_pred == "de" and [s.lang for s in got[3].spans] == ["en", "de"] and 0 < got[3].score < 1
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6))
    assert got[7].lang_pred in model.languages
    held = language_id.held_out_languages(docs)
    assert held.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert held.join(docs.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred").count() == 0
    assert language_id.held_out_languages(empty(spark)).count() == 0


def test_language_is_unknown_only_without_a_letter(spark):
    docs = frame(spark, [EN, DE] * 10, langs=["en", "de"] * 10)
    model = language_id.learn(docs)
    letters = ["日本語", "привет", "\u0450", "Ｈｅｌｌｏ", "𐐀𐐁", "ᚠᚢ", "ⴰⵣ", "a", "1 ª"]
    none = ["", None, "12 34", "\u0301", "٣٤ ۵", "!?", "\u200d", "  \n", "½ ² №", "😀"]
    got = by_id(language_id.identify(frame(spark, letters + none), model, with_spans=False).select("row.doc_id", "lang_pred", "score"))
    assert all(got[i].lang_pred in ("en", "de") and 0 < got[i].score <= 1 for i in range(len(letters)))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in range(len(letters), len(letters + none)))
    found = language_id.held_out_languages(awkward(spark).unionAll(docs.selectExpr("doc_id + 50 AS doc_id", *docs.columns[1:]))).collect()
    assert len(found) == 32 and all(0 <= r.score <= 1 for r in found)


def plain_path(score, switch):
    """The best labels of the words by trying what every word's best predecessor is, one word after the other."""
    best, back = list(score[0]), []
    for row in score[1:]:
        step = [max((best[j] - (switch if j != k else 0), -(j != k), -j) for j in range(len(row))) for k in range(len(row))]
        back.append([-s[2] for s in step])
        best = [s[0] + x for s, x in zip(step, row, strict=True)]
    state = max(range(len(best)), key=lambda k: (best[k], -k))
    path = [state]
    for row in reversed(back):
        path.append(state := row[state])
    return path[::-1], max(best)


def test_predictions_equal_a_plain_viterbi(spark):
    draw = __import__("random").Random(8)
    de, en = DE.split(), EN.split()
    docs = frame(spark, [EN, DE] * 20, langs=["en", "de"] * 20)
    model = language_id.learn(docs)
    texts = [" ".join(x for _ in range(draw.randrange(1, 6)) for x in draw.choices(draw.choice([de, en]), k=draw.randrange(1, 30))) for _ in range(40)]
    import pyarrow as pa

    words = language_id.words_of(pa.array(texts))
    score, known = language_id.word_scores(words, model)
    predicted, share, _ = language_id.predict_piece(pa.array(texts), model, 6.0, False)
    for d in range(len(texts)):
        a, z = words.first[d], words.first[d + 1]
        path, _ = plain_path(score[a:z].tolist(), 6.0)
        votes = [path.count(k) for k in range(2)]
        assert abs(share[d] - max(votes) / len(path)) < 1e-9 and (votes[0] == votes[1] or predicted[d] == model.languages[votes.index(max(votes))])


def test_plain_decision_agrees_with_viterbi():
    import numpy as np

    draw = np.random.default_rng(5)
    score = draw.normal(size=(4000, 3)) * 2
    score[:2000, 1] += 0.6
    first = np.array([0, 500, 500, 1200, 2000, 2001, 4000])
    best, sure = language_id.plain(score, first, 18.0)
    paths = language_id.viterbi([score[a:z] for a, z in zip(first[:-1], first[1:], strict=True)], 18.0)
    for d, path in enumerate(paths):
        if sure[d] and len(path):
            assert (path == best[d]).all()
    assert sure.any()


def test_toxicity(spark):
    draw = __import__("random").Random(3)
    plain = lambda n: " ".join(f"w{draw.randrange(300)}" for _ in range(n))
    clean = [f"{plain(12)}. {plain(9)}" for _ in range(80)]
    bad = [f"{plain(8)}. you are a zorgling{i % 7} {plain(5)}" for i in range(40)]
    docs = frame(spark, clean + bad)
    labels = spark.createDataFrame([(i, 1, int(i >= 80)) for i in range(120)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.held_out_toxicity(docs, labels))
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id >= 80) for r in held)
    model = toxicity.hand_model()
    probe = frame(spark, ["you are an idiot", "you are not an idiot", "he said you are an idiot", "hello", "", None])
    s = {r.doc_id: r.score for r in toxicity.score(probe, model).select("row.doc_id", "score").collect()}
    assert s[0] > s[2] > s[3] and s[0] > s[1] > s[3] and s[3] == s[4] == s[5]
    assert toxicity.held_out_toxicity(docs, labels.limit(0)).count() == 120
    found = toxicity.held_out_toxicity(awkward(spark), labels).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert toxicity.held_out_toxicity(empty(spark), labels).count() == 0


def test_two_halves_beat_a_third_language():
    # A is ahead of C by 17 in the first half, B in the second; C is the best single one, and A to B better by 16
    score = np.array([[0.0, -90.0, -8.5]] * 2 + [[-90.0, 0.0, -8.5]] * 2)
    best, sure = language_id.plain(score, np.array([0, 4]), 18.0)
    assert list(best) == [2] and list(sure) == [False]
    assert list(language_id.viterbi([score], 18.0)[0]) == [0, 0, 1, 1]
    assert language_id.plain(np.array([[0.0, -8.0, -9.0]] * 3), np.array([0, 3]), 18.0)[1].all()


def test_toxicity_is_of_clauses_and_not_of_words():
    import pyarrow as pa

    model = toxicity.hand_model()
    lex, m = toxicity.lexicon(model.insults), toxicity.machine(dict(zip(toxicity.KINDS, model.weights, strict=True)))

    def flagged(text):
        x = toxicity.log_odds(toxicity.clause_features(toxicity.read(pa.array([text])), lex, m), model.weights, model.bias)
        return float(1 / (1 + np.exp(-x[0]))) >= toxicity.THRESHOLD

    for text in ("you are an idiot", "i will kill you", "we will kill them all", "hijo de puta", "tu es stupide", "du bist ein trottel", "what a moron. what a clown"):
        assert flagged(text), text
    for text in ("idiot", "take out the trash", "you are not an idiot", "i will never kill you", "he said he will kill you", "she said you are an idiot", "killing time", "you. idiot", "", "hello", "the movie beat them all", "i hurt you not", "la película golpea a ellos"):
        assert not flagged(text), text


def test_the_composed_machine_equals_its_parts_in_turn():
    draw = __import__("random").Random(2)
    parts = [toxicity.things(), toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.aimed()]
    m = toxicity.machine(toxicity.PRIOR)
    for _ in range(300):
        read = draw.choices(toxicity.CLASSES, k=draw.randrange(1, 15))
        marked = read
        for f in parts:
            state, out = f.start, []
            for c in marked:
                state, symbol, _ = f.arcs[state, c]
                out.append(symbol)
            marked = out
        state, got = 0, []
        for c in read:
            code = toxicity.CLASSES.index(c)
            got.append((m.kind[state][code], m.weight[state][code]))
            state = m.to[state][code]
        assert got == [(toxicity.KINDS.index(s) if s in toxicity.KINDS else -1, toxicity.PRIOR.get(s, 0.0)) for s in marked]
        behind, taken = 0, []
        for c in reversed(read):
            behind, code = m.back[behind][toxicity.CLASSES.index(c)]
            taken.insert(0, toxicity.CLASSES[code])
        assert taken == ["other" if c == "threat" and "negation" in read[k + 1 : k + 3] else c for k, c in enumerate(read)]


def test_words_aimed_at_nobody_never_outweigh_one_that_is_aimed(spark):
    # learned from words alone, so isolated insults cost much and aimed ones were never seen
    texts = [f"word{i} moron scum stupid more{i * i}" for i in range(60)] + [f"word{i} plain talk more{i * 3}" for i in range(120)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(180)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, labels)
    probe = ["moron. scum! stupid. moron moron. idiot scum", "you are a moron", "i will kill you"]
    s = {r.row.doc_id: r.score for r in toxicity.score(frame(spark, probe), model).collect()}
    assert s[0] < s[1] and s[0] < s[2]
    told = {r["without"]: r for r in toxicity.verdicts_by_machine(frame(spark, [*probe, "he said you are a moron", "you are not a moron", "the movie beat them", "i kill you not"]), toxicity.hand_model()).collect()}
    assert told["nothing"].freed == told["nothing"].added == 0
    assert all(told[k].added == 1 for k in ("things", "taken back", "negation", "reported")) and told["targeted"].freed == 1 and told["aimed"].freed == 1
