import numpy as np
import pytest

from tabulon.llm import abuse as A

CLEAN = ["The rotor is connected to the housing.", "A valve opens when the pressure exceeds 7 MHz.", "The bitch in heat was examined by the veterinary unit.", "The filter removes words such as idiot from messages.", "Reference is made to XW5671, which describes a shaft.", "I am angry that my letter was ignored."]
FOUL = ["You are a stupid idiot and a worthless pig.", "Shut your mouth, you filthy idiot.", "These people are vermin and should be wiped out.", "Somebody should put a bullet in your head.", "Send me pictures of your naked body."]


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for i in range(n):
        body = [str(s) for s in rng.choice(CLEAN, 12)]
        bad = i % 5 == 0
        if bad:
            body.insert(int(rng.integers(0, 12)), str(rng.choice(FOUL)))
        texts.append(" ".join(body))
        y.append(float(bad) if rng.random() > 0.03 else 1.0 - bad)  # annotators err
    return texts, np.array(y), np.array([i % 5 == 0 for i in range(n)])


@pytest.fixture(scope="module")
def learnt():
    texts, y, truth = corpus()
    reader = A.Reader(A.vocabulary(texts))
    c = A.Corpus.of(reader, texts, y)
    m = A.learn(c)
    return reader, m, A.cutoff(c.y, A.worst_scores(c, m))


def top(learnt, text):
    reader, m, _ = learnt
    f, s = A.document_features(reader, text)
    return m.scores(f, s.astype(np.int64)).max() if len(s) else -np.inf


def test_held_out_documents_are_told_apart_despite_wrong_labels(learnt):
    texts, _, truth = corpus(200, 9)
    hit = np.array([top(learnt, t) > learnt[2] for t in texts])
    assert hit[truth].mean() > 0.95 and hit[~truth].mean() < 0.03


@pytest.mark.parametrize("text", [
    "You are a stup1d 1d10t and a worthless pig.", "you are a $tupid idi0t and a worthless pig", "Y​ou are a s​t​u​pid idiot and a worthless pig", "you are a stupіd іdіоt and a worthless pig",
    "you are a stuuuuupid idiooooot and a worthlessss pig", "you are a s.t.u.p.i.d i.d.i.o.t and a worthless pig", "you are a s t u p i d i d i o t and a worthless pig", "YOU ARE A STUPID IDIOT AND A WORTHLESS PIG", "you are a stu-\npid id-\niot and a worth-\nless pig",
    "you are a s****d i***t and a worthless pig", "ｙｏｕ are a ｓｔｕｐｉｄ ｉｄｉｏｔ and a worthless pig",
])
def test_disguises_are_seen_through(learnt, text):
    assert top(learnt, "The rotor is connected to the housing. " * 400 + text) > learnt[2]


@pytest.mark.parametrize("text", ["The filter removes words such as idiot from messages.", "A valve opens when the pressure exceeds 7 MHz.", "", "   ", "\n\n", "1 2 3", "。！？"])
def test_clean_and_empty_texts_stay_below(learnt, text):
    assert top(learnt, text) <= learnt[2]


def test_reader_repairs_words():
    r = A.Reader({"stupid": 5, "house": 9, "kiss": 4, "the": 50, "they": 9, "spent": 5})
    assert [r.plain(w) for w in ("Stup1d", "$tupid", "stuuuupid", "ѕtupіd", "kissss", "claim", "12", "C27H34")] == ["stupid", "stupid", "stupid", "stupid", "kiss", "claim", "<number>", "<number>"]
    assert r.split_run("theyspent") == ["they", "spent"]
    assert r.read("t h e y spent") == r.read("they spent")


def test_han_text_is_read_in_pairs_and_sentences():
    r = A.Reader({})
    ids = np.array(r.read("この馬鹿野郎。装置である。"))
    assert (ids == -1).sum() >= 2 and len(ids) > 8


def test_long_passages_are_read_in_overlapping_windows():
    r = A.Reader({})
    ids = np.array(r.read(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))), np.int64)
    f, p = A.passages(ids)
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)])
    assert len(sizes) == 9 and sizes.max() <= 2 * A.PASSAGE
    assert A.passages(np.empty(0, np.int64))[0].size == 0


def test_machine_learns_an_interaction_no_linear_weights_can():
    rng = np.random.default_rng(0)
    ex = [np.array([1 + (i % 2), 3 + (i // 2 % 2)]) for i in range(400)]
    y = np.array([float((i % 2) == (i // 2 % 2)) for i in range(400)])
    m = A.fit(ex, y, np.ones(400), epochs=60, rate=0.1)
    s = m.scores(np.concatenate(ex[:4]), np.arange(0, 8, 2))
    assert ((s > 0) == (y[:4] > 0.5)).all() and rng is not None


def test_scoring_tables(spark):
    texts, y, truth = corpus(150)
    rows = [(i, t, "src") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "src"), (902, "x" * 60_000, "src"), (None, "You are a stupid idiot and a worthless pig.", "src")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, 1), (None, 1), (5, None), (7777, 1)], "doc_id bigint, toxic int")
    t = A.train(docs, labels)
    reader, m, cut = t.reader, t.machine, t.cutoff(A.score(docs, t.reader, t.machine))
    assert len(t.y) == len(t.held_out) == 150
    s = A.score(docs, reader, m)
    got = {r.doc_id: r for r in s.collect()}
    assert len(got) == len(rows) and got[900].score is None and got[901].passages == 0 and got[902].passages == 1
    hit = {k for k, r in got.items() if r.score is not None and r.score > cut}
    assert None in hit and np.mean([i in hit for i in np.flatnonzero(truth)]) > 0.9 and np.mean([i in hit for i in np.flatnonzero(~truth)]) < 0.05
    assert {r.doc_id: r.score for r in A.score(docs.repartition(5), reader, m).collect()} == {k: r.score for k, r in got.items()}
    assert A.score(docs.where("false"), reader, m).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 0")):
        t = A.train(docs, none)
        r2, m2, c2 = t.reader, t.machine, t.cutoff(A.score(docs, t.reader, t.machine))
        assert A.score(docs, r2, m2).where(f"score > {c2}").count() == 0


def test_cutoff_corrects_for_labelled_documents_being_picked():
    rng = np.random.default_rng(0)
    y = np.r_[np.ones(400), np.zeros(1600)]
    top = np.r_[rng.normal(2, 1.5, 400), rng.normal(-2, 1.5, 1600)]
    assert A.cutoff(y, top, 0.01) > A.cutoff(y, top) == A.cutoff(y, top, None)
    assert A.cutoff(np.empty(0), np.empty(0)) == 0.0


def letters(n, seed, share=0.33):
    """Letters on one of 60 subjects, in sentences that name it; of those on the first 20 this share is abusive, of others none; annotators err."""
    rng = np.random.default_rng(seed)
    texts, y, truth = [], [], []
    for _ in range(n):
        k = int(rng.integers(60))
        thing = f"{chr(97 + k % 26)}o{chr(97 + k // 26)}er {chr(97 + k // 26)}i{chr(97 + k % 26)}or"
        body = [f"Honestly, anybody can build a {thing} like that.", f"The applicant has misunderstood the {thing} completely.", f"We have sold such a {thing} for years.", "The enclosed search was careless."]
        bad = k < 20 and rng.random() < share
        if bad:
            body.insert(int(rng.integers(4)), str(rng.choice(FOUL)))
        texts.append(" ".join(body))
        truth.append(bad)
        y.append(float(bad) if rng.random() > 0.08 else 1.0 - bad)
    return texts, np.array(y), np.array(truth)


@pytest.mark.parametrize("background", [0, 1200])
def test_subjects_of_wrongly_labelled_documents_are_not_learnt(background):
    seen, y, _ = letters(800, 1)
    rest, _, _ = letters(background, 2, 0.05)
    reader = A.Reader(A.vocabulary(seen))
    m = A.learn(A.Corpus.of(reader, seen + rest, np.r_[y, np.full(background, np.nan)]))
    texts, _, truth = letters(600, 3)
    top = A.worst_scores(A.Corpus.of(reader, texts, np.zeros(600)), m)
    assert top[truth].min() > top[~truth].max()


def test_background_does_not_teach_that_rare_abuse_is_clean():
    rare = "Los extranjeros son una plaga."
    seen, y, _ = letters(800, 1)
    seen += [f"{t} {rare}" for t in letters(3, 5, 0.0)[0]]
    rest = [f"{t} {rare}" if i < 15 else t for i, t in enumerate(letters(1200, 2, 0.05)[0])]
    reader = A.Reader(A.vocabulary(seen))
    m = A.learn(A.Corpus.of(reader, seen + rest, np.r_[y, np.ones(3), np.full(1200, np.nan)]))
    texts, _, truth = letters(600, 3)
    clean = A.worst_scores(A.Corpus.of(reader, texts, np.zeros(600)), m)[~truth]
    assert A.worst_scores(A.Corpus.of(reader, [rare], np.zeros(1)), m)[0] > clean.max() + 1


def test_documents_labelled_abusive_by_mistake_are_not_believed():
    texts, y, truth = letters(800, 1)
    c = A.Corpus.of(A.Reader(A.vocabulary(texts)), texts, y)
    got, _ = A.believed(c, A.first_scores(c))
    wrong = (y > 0.5) & ~truth
    assert wrong.sum() > 30 and got[wrong].mean() < 0.15 and got[(y > 0.5) & truth].mean() > 0.95


def test_drawn_out_words_are_not_known_however_often_they_occur():
    r = A.Reader(A.vocabulary(["Whoever wrote thhhhhis is stuuuuupid.", "Thhhhhis stuuuuupid claim.", "Thhhhhis is a stuuuuupid letter."] + ["This is stupid."] * 3))
    assert r.read("Thhhhhis is stuuuuupid") == r.read("this is stupid")


def test_background_is_documents_without_labels(spark, monkeypatch):
    docs = spark.range(100).selectExpr("id as doc_id", "if(id % 10 = 9, ' ', concat('text ', id)) as text")
    labels = spark.createDataFrame([(i, "a", 0) for i in range(0, 40)] + [(3, "b", 1), (41, "b", None), (None, "a", 1)], "doc_id bigint, annotator string, toxic int")
    rows = A.labelled(docs, labels).collect()
    assert {r.doc_id: r.y for r in rows} == {i: (None if i >= 40 else 0.5 if i == 3 else 0.0) for i in range(100) if i % 10 != 9 and i != 41}
    monkeypatch.setattr(A, "BACKGROUND", 30)
    got = [r.doc_id for r in A.labelled(docs, labels, most=10).collect() if r.y is None]
    assert 0 < len(got) <= 30 and min(got) >= 40
