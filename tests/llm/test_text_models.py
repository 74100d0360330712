"""Language, toxicity, personal data and page extraction."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from millrace.llm import html_extract, langid, pii, queries, toxicity

# -- language


def sentences(seed, parts, n):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(rnd.randint(3, 40))) for _ in range(n)]


LANGS = {"en": ["the", "ing", "th", "er", "on", "and"], "de": ["sch", "ung", "ü", "ein", "keit", "ver"], "fr": ["eau", "é", "ou", "tion", "que", "è"]}


def test_kneser_ney_is_a_distribution():
    text = " ".join(sentences(1, LANGS["de"], 30))
    keys, counts = langid.counted_grams(text, 3)
    model = langid.KneserNey(keys, counts, 3)
    alphabet = np.unique(langid.symbols(text)).astype(np.uint64)
    for context in (keys[:5] >> np.uint64(16)).tolist() + [int(alphabet[1]) << 16 | int(alphabet[2])]:
        p = model.prob((np.uint64(context) << np.uint64(16)) | alphabet)
        assert abs(p.sum() - 1) < 0.02 and (p > 0).all()


def test_language_identification(spark):
    rows = [(i, t, lang) for k, (lang, parts) in enumerate(LANGS.items()) for i, t in enumerate(sentences(k, parts, 120), 1000 * k)]
    rows += [(9001, None, "en"), (9002, "x", None), (9003, "", "de")]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    test = [(i, t, lang) for k, (lang, parts) in enumerate(LANGS.items()) for i, t in enumerate(sentences(50 + k, parts, 40), 1000 * k)]
    docs = spark.createDataFrame([*test, (1, None, "en"), (2, "", "en"), (3, "12 !!", "en"), (3, "12 !!", "en"), (4, "日本", None), (5, "a", "en"), (6, "schung " * 200_000, "de")], "doc_id bigint, text string, lang string")
    got = langid.identify(docs.withColumnRenamed("lang", "score"), model).collect()
    want = [x[2] for x in test]
    assert np.mean([g.lang_pred == w for g, w in zip(got, want, strict=False)]) > 0.98
    rest = got[len(test) :]
    assert [r.lang_pred for r in rest[:4]] == ["und"] * 4 and all(r.rejected for r in rest[:4])
    assert rest[4].rejected and rest[4].lang_pred in model.langs and rest[6].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_model_in_pieces_is_the_whole(monkeypatch):
    text = " ".join(sentences(3, LANGS["en"], 200))
    keys, counts = langid.counted_grams(text, 4)
    m = langid.KneserNey(keys, counts, 4)
    model = langid.LanguageModel(["a", "b"], 4, keys, np.stack([-np.log(m.prob(keys))] * 2, 1), [m, m], np.full(2, np.inf), 1.0)
    other = " ".join(sentences(4, LANGS["fr"], 50)) + text
    whole = model.entropies(other)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 97)
    assert np.allclose(whole, model.entropies(other))
    sym = langid.symbols(other)
    assert np.allclose(whole[0], -np.log(m.prob(langid.grams(sym, 4))).mean())


def test_no_language_to_learn(spark):
    model = langid.fit_languages(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert model.predict("some text") == ("und", 0.0, True)


# -- toxicity


def test_folding():
    assert toxicity.folded_words("1D10T! l0ser, ѕtuріd ｓcum tra$h 2024 id​iot") == ["idiot", "loser", "stupid", "scum", "trash", "2024", "idiot"]
    assert toxicity.folded_words("") == []


def test_exceptions_and_length():
    lex = toxicity.Lexicon({"trash": 3.0, "lowei*": 2.0}, frozenset({"trash can"}))
    assert [w for *_, w in lex.matches("the trash can is trash".split())] == [3.0]
    assert [w for *_, w in lex.matches("loweischaft xlowei lowei trashy".split())] == [2.0, 2.0]
    short, long = lex.density("trash"), lex.density("trash " + "word " * 5000)
    assert short > long > 0 and lex.density(None) == 0
    assert lex.score(None) == lex.score("")


def test_lexicon_is_learned(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 7))) for _ in range(300)]

    def doc(bad):
        t = rnd.choices(words, k=rnd.randint(5, 150))
        if bad:
            for _ in range(rnd.randint(1, 4)):
                t.insert(rnd.randrange(len(t)), rnd.choice(["zonker", "ZONKER", "z0nker", "quib" + rnd.choice(words)]))
        return " ".join(t)

    rows = [(i, doc(i % 8 == 0), int(i % 8 == 0)) for i in range(800)] + [(900, None, 1), (901, "zonker", None)]
    taught = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lex = toxicity.fit_lexicon(taught.drop("toxic"), taught.drop("text"))
    test = [(i, doc(i % 8 == 0), i % 8 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in test] + [(500, None, "x"), (501, "", "x"), (501, "", "x")], "doc_id bigint, text string, score string")
    got = [r.score for r in toxicity.toxicity(docs, lex).collect()]
    right = [(s >= 0.7) == y for s, (_, _, y) in zip(got, test, strict=False)]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in got) and max(got[-3:]) < 0.7
    kept = toxicity.drop_toxic(docs, lex)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.7 for s in got)


def test_exceptions_are_learned(spark):
    """A word that is toxic alone and harmless in a phrase: in the lexicon of the registered query, the phrase is no match."""
    rnd = random.Random(21)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 7))) for _ in range(300)]

    def doc(*extra):
        t = rnd.choices(words, k=40)
        for x in extra:
            t.insert(rnd.randrange(len(t)), x)
        return " ".join(t)

    rows = [(i, doc(*["zonker"] * rnd.randint(1, 3)), 1) if i % 4 == 0 else (i, doc(*["zonker valve"] * (i % 40 == 1)), 0) for i in range(2400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lex = queries.learned_lexicon(frame.drop("toxic"), frame.drop("text"))
    assert lex.weights.keys() & {"zonker", "zonk*", "zonke*"} and lex.exceptions == {"zonker valve"}
    assert lex.score(doc("ZONKER valve", "z0nker valve")) < 0.1 and lex.score(doc("zonker valve", "zonker")) > 0.7
    assert lex.score(doc("zonker", "zonker")) >= 0.7
    none = toxicity._phrase_counts(iter([pd.DataFrame({"text": ["a b", None], "toxic": [0, 1]})]), {"zonker": 1.0})
    assert list(none) == []


def test_many_exceptions_take_linear_time():
    lex = toxicity.Lexicon({"trash": 3.0}, frozenset({"trash can", "the trash can"}))
    assert lex.matches("the trash can".split() * 100_000) == [] and len(lex.matches("trash".split() * 3)) == 3


def test_one_label_teaches_nothing(spark):
    one = spark.createDataFrame([(1, "a b c", 0)], "doc_id bigint, text string, toxic int")
    lex = toxicity.fit_lexicon(one, one)
    assert lex.weights == {} and lex.score("anything") < 0.7


# -- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans_are_the_plain_patterns():
    rnd = random.Random(12)
    pieces = ["a", "b@c", ".", "com", "@", " ", "-", "+", "1", "23", "255", "256", "0300", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "x.y_z@q-r.co.uk", "é", "日", "(", ")", "%", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choices(pieces, k=rnd.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)
    assert pii.base_spans(None) == [] and pii.base_spans("") == []


def test_base_spans_are_linear_in_the_text():
    assert pii.base_spans("a" * 400_000 + "@" + "b" * 400_000) == []
    assert pii.base_spans("9" * 400_000) == []
    assert pii.base_spans("a@" * 200_000) == []


def test_contexts_find_what_patterns_miss(spark):
    rnd = random.Random(13)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]

    def with_(x, lead="my phone:"):
        return " ".join([*rnd.choices(words, k=8), lead, x, *rnd.choices(words, k=8)])

    docs = [(i, with_(f"+1 (555) 123-{4000 + i}")) for i in range(40)]
    docs += [(100, with_("555-0199-77")), (101, with_("5550123499", "order number")), (102, None), (103, ""), (103, ""), (None, "x@y.org"), (104, with_("call", "my phone:"))]
    frame = spark.createDataFrame([(i, t, "b", 1) for i, t in docs], "doc_id bigint, text string, base string, seen int")
    got = {r.doc_id: r for r in pii.find_personal_data(frame).collect()}
    found = [(s.kind, docs[40][1][s.start : s.end]) for s in got[100].spans]
    assert found == [("phone", "555-0199-77")] and got[100].base == []
    assert got[101].spans == [] and got[102].spans == [] and got[104].spans == []
    assert [s.kind for s in got[None].spans] == ["email"]
    assert all([tuple(s) for s in got[i].base] == plain_spans(docs[i][1]) for i in range(40))
    assert pii.find_personal_data(frame).count() == len(docs) and pii.find_personal_data(frame.limit(0)).count() == 0


def test_contexts_find_whole_identifiers(spark):
    """Numbers with blanks and parentheses, and long identifiers, in trusted contexts."""
    rnd = random.Random(14)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]

    def with_(x, lead="my phone:"):
        return " ".join([*rnd.choices(words, k=8), lead, x, *rnd.choices(words, k=8)])

    docs = [(i, with_(f"+1 (555) 123-{4000 + i}")) for i in range(40)] + [(50 + i, with_(f"u{i}@mail{i}.org", "write me at")) for i in range(40)]
    cards = [c for c in (f"4111 1111 1111 {k:04}" for k in range(1000, 3000)) if luhn(c.replace(" ", ""))][:40]
    docs += [(100 + i, with_(c, "my card:")) for i, c in enumerate(cards)]
    long = "x9" * 200
    hard = [("my phone:", "212 555 0199", "phone"), ("my phone:", "(555) 123-4567", "phone"), ("my card:", "4111 1111 1111 1112", "card"), ("my phone:", "212. 555. 0199", "phone"), ("write me at", long, "email")]
    docs += [(200 + i, with_(x, lead)) for i, (lead, x, _) in enumerate(hard)] + [(300, "a my phone: 212 555 0199. 30 days b")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    texts = dict(docs)
    for i, (_, x, kind) in enumerate(hard):
        assert [(s.kind, texts[200 + i][s.start : s.end]) for s in got[200 + i]] == [(kind, x)]
    assert [texts[300][s.start : s.end] for s in got[300]] == ["212 555 0199"]


def test_candidates():
    def found(t, taken=()):
        return [t[s:e] for s, e in pii._candidates(t, list(taken))]

    assert found("a (212) 555-0199, b7 (call 5551234) 12 of 9.") == ["(212) 555-0199", "b7", "5551234", "12", "9"]
    assert found("x " + "9" * 100 + " y@z! 1 - 2 +3 4") == ["9" * 100, "y@z", "1 - 2", "+3 4"]
    assert found("12 34 56", [(3, 5)]) == ["12", "56"]
    for t in ("a" * 400_000 + " 1", "1 " * 200_000, "9" * 400_000, "a@" * 200_000, "1" + " " * 400_000 + "2", "(1" * 200_000):
        assert found(t)


# -- pages


@pytest.fixture(scope="module")
def page_model():
    return html_extract.train(html_extract.labelled_pages())


def test_held_out_blocks(page_model):
    right = n = 0
    for page, marks in html_extract.labelled_pages(150, seed=1234):
        nodes = html_extract.parse(page)
        p, _ = html_extract.Forest([nodes], page_model.index).marginals(page_model.weights, page_model.edges)
        got = [q >= 0.5 for x, q in zip(nodes, p, strict=True) if x.text is not None]
        right += sum(a == b for a, b in zip(got, marks, strict=True))
        n += len(marks)
    assert right / n > 0.97


def test_marginals_are_sums_over_all_labellings():
    rnd = np.random.default_rng(1)
    nodes = html_extract.parse("<body><div><p>a</p><p>b</p></div><p>c</p></body>")
    index = {}
    forest = html_extract.Forest([nodes], index, grow=True)
    w, e = rnd.normal(size=len(index)), rnd.normal(size=(2, 2, 2))
    p, pair = forest.marginals(w, e)
    n = len(nodes)
    own = np.bincount(forest.at, w[forest.feature], n)
    total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        s = math.exp(sum(own[i] * y[i] for i in range(n)) + sum(e[forest.edge[i], y[x.parent], y[i]] for i, x in enumerate(nodes) if x.parent >= 0))
        total += s
        for i, x in enumerate(nodes):
            one[i] += s * y[i]
            if x.parent >= 0:
                both[i, y[x.parent], y[i]] += s
    assert np.allclose(p, one / total) and np.allclose(pair[1:], both[1:] / total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>A &amp; B</h1><p>First   part<br>goes on.<p>Caf&eacute; &#8212; &lt;b&gt; <b>bold</b>.</p><ul><li>One item here.<li>Two items here.</ul></article>
<section class="comments"><h3>Comments</h3><p>I like this a lot.</p></section><form><p>Mail</p><input><textarea>x</textarea></form>
<footer>&copy; 2024 Someone.</footer></body></html>"""


def test_page(page_model):
    assert page_model.text(PAGE).split("\n\n") == ["A & B", "First part goes on.", "Café — <b> bold.", "One item here.", "Two items here."]


def test_formulas_of_the_article_stay(page_model):
    page = PAGE.replace("First ", "First <math><mi>x</mi><mo>=</mo><mn>2</mn></math> ")
    assert page_model.text(page).split("\n\n")[1] == "First x=2 part goes on."


def test_broken_pages(page_model):
    for page in ("", "<", "<p", "<p>x", "</p></div>x", "<!--", "<script>", "<div " * 2000, "<div>" * 3000 + "x", "a < b & c &amp", '<p class="', "<title>x", "<p>" + "w " * 200_000):
        assert isinstance(page_model.text(page), str)
    for k in range(0, len(PAGE), 37):
        page_model.text(PAGE[:k])


def test_extract(spark, page_model):
    rows = [(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, None, "", "t"), (3, None, "", "t"), (4, "u", "<nav><a href=x>menu</a></nav>", "t")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"), page_model)
    assert got.columns == ["page_id", "url", "text"]
    assert [r.text for r in got.orderBy("page_id").collect()] == [page_model.text(PAGE), "", "", "", ""]
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string"), page_model).count() == 0


# -- personal data: the graph, plainly


def graph_spans(docs, rounds=3, least_seeds=5, trust=0.8):
    """The bootstrapping as loops over dictionaries. All spans of each document, by number of the row."""
    places = []
    for n, (_, t) in enumerate(docs):
        t = t or ""
        places += [(n, k, s, e, t[s:e], p) for k, s, e in pii.found_places(t, plain_spans(t), 4) for p in pii._context(t, s, e)]
    seed = {}
    for _, k, _, _, x, p in places:
        seed[p, x] = max(k, seed.get((p, x), ""))
    by_pattern = {}
    for (p, x), k in seed.items():
        by_pattern.setdefault(p, {})[x] = k
    able = [(p, k) for p, xs in by_pattern.items() for k in set(xs.values()) - {""} if sum(v == k for v in xs.values()) >= least_seeds]
    conf = {(p, k, x): float(v == k) for p, k in able for x, v in by_pattern[p].items()}

    def means():
        return {(p, k): sum(conf[p, k, x] for x in by_pattern[p]) / (len(by_pattern[p]) + 1) for p, k in able}

    for _ in range(rounds):
        good, doubt = means(), {}
        unknown = {(p, k, x) for p, k, x in conf if by_pattern[p][x] in ("", "secret") and by_pattern[p][x] != k}
        for p, k, x in unknown:
            doubt[x, k] = doubt.get((x, k), 1.0) * (1 - good[p, k])
        conf = {(p, k, x): 1 - doubt[x, k] if (p, k, x) in unknown else c for (p, k, x), c in conf.items()}
    trusted = {}
    for (p, k), c in means().items():
        if c >= trust:
            trusted[p] = max(trusted.get(p, (0, "")), (c, k))
    more = {}
    for n, k, s, e, _, p in places:
        if p in trusted and k in ("", "secret"):
            more[n, s, e] = max(more.get((n, s, e), (0, "")), trusted[p])
    out = {n: [(k, s, e) for k, s, e in plain_spans(t or "")] for n, (_, t) in enumerate(docs)}
    for (n, s, e), (_, k) in more.items():
        out[n].append((k, s, e))
    order = [*pii.KINDS, "secret"]
    return {n: sorted(x, key=lambda x: (order.index(x[0]), x[1:])) for n, x in out.items()}


def secret_docs(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(60)]
    pick = lambda chars, n: "".join(rnd.choices(chars, k=n))

    def around(x):
        return " ".join([*rnd.choices(words, k=6), x, *rnd.choices(words, k=6)])

    makes = [
        lambda: f'token = "{pick("0123456789abcdef", 40)}"', lambda: "QZKX" + pick("ABCDEFGHJKLMNP23456", 16), lambda: f"key={pick('abcdef0123456789', 32)}",
        lambda: f"v{rnd.randint(1, 9)}.{rnd.randint(0, 20)}", lambda: f"call +1 (555) 123-{rnd.randint(1000, 9999)}", lambda: f"call 555-{rnd.randint(1000, 9999)}-{rnd.randint(10, 99)}",
        lambda: f"x.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.org", lambda: 'token = "hunter2-7"', lambda: f"id {rnd.randint(10, 9999)}", lambda: "",
    ]
    docs = [(k, around(rnd.choice(makes)()) + " " + around(rnd.choice(makes)())) for k in range(300)]
    return [*docs, (5, docs[5][1]), (5, docs[6][1]), (None, 'token = "0123abcd4567efab89012345"'), (400, None), (401, ""), (402, "w " * 50_000 + 'token = "abc-1"')]


def test_bootstrapping_is_the_plain_graph(spark):
    docs = secret_docs(51)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id bigint, text string, key string, pattern string")
    got = sorted(repr((r.doc_id, [tuple(s) for s in r.spans])) for r in pii.find_personal_data(frame).collect())
    want = graph_spans(docs)
    assert got == sorted(repr((docs[n][0], x)) for n, x in want.items())
    assert sum(k == "secret" for x in want.values() for k, *_ in x) > 100


def test_unseen_secrets_are_found_by_context_and_beginning(spark):
    """What looks of secrets miss comes through the patterns, and the same looks in no shared context are nothing."""
    rnd = random.Random(52)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]
    keys = ["QZKX" + "".join(rnd.choices("ABCDEFGHJKLMNPRSTUVWXYZ234567", k=16)) for _ in range(400)]
    seeds = [k for k in keys if pii.looks_secret(k)]
    unseen = [k for k in keys if not pii.looks_secret(k) and any(c.isdigit() for c in k)]
    assert len(unseen) > 50
    docs = [(i, " ".join([*rnd.choices(words, k=9), k, *rnd.choices(words, k=9)])) for i, k in enumerate(seeds + unseen)]
    docs += [(1000 + i, f'token = "{rnd.randbytes(20).hex()}"') for i in range(30)] + [(2000, 'token = "pass-word1" x'), (2001, "commit 8c1b93e37ac04d5f8e2a here"), (2002, "QZKX is 4 letters")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, k in enumerate(seeds + unseen):
        at = docs[i][1].index(k)
        assert got[i] == [("secret", at, at + 20)]
    assert got[2000] == [("secret", 9, 19)] and got[2001] == [] and got[2002] == []


# -- brute force: language and toxicity


def plain_symbols(text):
    """Letters in lower case, all else one blank, one at either end."""
    out = []
    for ch in " " + text + " ":
        low = ch.lower()
        x = (low if len(low) == 1 else ch) if ch.isalpha() else " "
        if x != " " or not out or out[-1] != " ":
            out.append(x)
    return "".join(out)


class PlainKneserNey:
    """Dictionaries and recursion; probabilities as in the textbook."""

    def __init__(self, texts, order, discount=0.75):
        self.order, self.d = order, discount
        self.counts = [{}]
        for t in texts:
            s = plain_symbols(t)
            for i in range(len(s) - order + 1):
                g = s[i : i + order]
                self.counts[0][g] = self.counts[0].get(g, 0) + 1
        for _ in range(order - 1):
            lower = {}
            for g in self.counts[-1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            self.counts.append(lower)
        self.follow = []
        for table in self.counts:
            follow = {}
            for g, n in table.items():
                total, kinds = follow.get(g[:-1], (0, 0))
                follow[g[:-1]] = (total + n, kinds + 1)
            self.follow.append(follow)

    def prob(self, g, level=0):
        if level == self.order:
            return 1.0 / (len(self.counts[-1]) + 1)
        lower = self.prob(g[1:], level + 1)
        total, kinds = self.follow[level].get(g[:-1], (0, 0))
        if not total:
            return lower
        return max(self.counts[level].get(g, 0) - self.d, 0) / total + self.d * kinds / total * lower

    def entropy(self, text):
        s = plain_symbols(text).ljust(self.order)
        grams = [s[i : i + self.order] for i in range(len(s) - self.order + 1)]
        return -sum(math.log(self.prob(g)) for g in grams) / len(grams)


def test_languages_are_those_of_plain_models(spark):
    taught = {lang: sentences(70 + k, parts, 25) for k, (lang, parts) in enumerate(LANGS.items())}
    plain = {lang: PlainKneserNey(t, 4) for lang, t in taught.items()}
    models = {}
    for lang, texts in taught.items():
        keys, counts = np.unique(np.concatenate([langid.grams(langid.symbols(t), 4) for t in texts]), return_counts=True)
        models[lang] = langid.KneserNey(keys, counts, 4)
    langs = sorted(LANGS)
    keys = np.unique(np.concatenate([models[x].tables[0][0] for x in langs]))
    cost = np.stack([-np.log(models[x].prob(keys)) for x in langs], 1)
    model = langid.LanguageModel(langs, 4, keys, cost, [models[x] for x in langs], np.full(3, np.inf), 2.0)
    texts = [t for k, parts in enumerate(LANGS.values()) for t in sentences(80 + k, parts, 15)] + ["a", "Ä", "日本 the", "x1y2", "the\tSCH eau", "zzz qqq"]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in got:
        h = {lang: plain[lang].entropy(texts[r.doc_id]) for lang in langs}
        assert np.allclose(model.entropies(texts[r.doc_id]), [h[x] for x in langs], atol=1e-6)
        best = min(h.values())
        assert h[r.lang_pred] <= best + 1e-9
        assert abs(r.score - 1 / sum(math.exp(-(x - best) * 2.0) for x in h.values())) < 1e-6


def plain_matches(words, weights, exceptions):
    """Each word against each entry, each match against each place of each exception."""
    spared = [(i, i + len(x)) for x in exceptions for i in range(len(words) - len(x) + 1) if words[i : i + len(x)] == x]
    total = 0.0
    for i in range(len(words)):
        best = 0.0
        for entry, w in weights.items():
            e = entry.rstrip("*").split(" ")
            n = len(e)
            if words[i : i + n - 1] == e[:-1] and i + n <= len(words) and (words[i + n - 1].startswith(e[-1]) if entry.endswith("*") else words[i + n - 1] == e[-1]):
                if not any(s <= i and i + n <= t for s, t in spared):
                    best = max(best, w)
        total += best
    return total


def test_scores_are_those_of_a_plain_matcher(spark):
    rnd = random.Random(61)
    vocabulary = ["bad", "badly", "bat", "ba", "can", "the", "trash", "trashy", "tr", "x"]
    for n in range(120):
        weights = {}
        for _ in range(rnd.randint(1, 6)):
            entry = " ".join(rnd.choices(vocabulary, k=rnd.choice((1, 1, 1, 2))))
            weights[entry + rnd.choice(("", "", "*"))] = rnd.choice((0.5, 1.0, 2.0, 3.25))
        # Entries that are exceptions too, and exceptions that overlap.
        exceptions = {" ".join(rnd.choices(vocabulary, k=rnd.choice((1, 2, 2, 3)))) for _ in range(rnd.randint(0, 4))}
        exceptions |= {rnd.choice(sorted(weights)).rstrip("*")} if n % 3 == 0 else set()
        lex = toxicity.Lexicon(weights, frozenset(exceptions), 0.8, -2.0)
        plain = [x.split(" ") for x in exceptions]
        texts = [rnd.choices(vocabulary, k=rnd.randint(0, 14)) for _ in range(12)]
        for w in texts:
            assert abs(sum(x for *_, x in lex.matches(w)) - plain_matches(w, weights, plain)) < 1e-9, (w, weights, exceptions)
    leet = str.maketrans("aes", "435")
    docs = [(k, rnd.choice((" ", ", ", "\n")).join(rnd.choice((x, x.upper(), x.translate(leet))) for x in w)) for k, w in enumerate(texts)]
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), lex).collect()}
    for k, w in enumerate(texts):
        z = 0.8 * plain_matches(w, weights, plain) / math.log(math.e + len(w) / 100) - 2.0
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9


def test_an_entry_that_is_an_exception_never_counts():
    assert toxicity.Lexicon({"bad": 3.0}, frozenset({"bad"})).matches(["bad", "bad"]) == []
    assert [w for *_, w in toxicity.Lexicon({"bad": 3.0, "bad*": 2.0}, frozenset({"bad"})).matches(["bad", "badly"])] == [2.0]
