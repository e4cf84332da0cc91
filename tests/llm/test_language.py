import numpy as np

from stratavec.llm import language as lid

WORDS = {"aa": "bato kilo runa teso maku", "bb": "xygh zwqr vvnt jjkp qqlm", "cc": "émou üllo ñara çeta ßoko"}


def corpus(spark, per=60):
    rng = np.random.default_rng(0)
    rows = [(k * per + j, " ".join(rng.choice(WORDS[lang].split(), 40)), lang) for k, lang in enumerate(WORDS) for j in range(per)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


EDGES = [(1, None), (2, ""), (3, "123 !!"), (None, "bato kilo"), (5, "bato kilo"), (5, "bato kilo"), (6, "xygh " * 50_000), (7, "日本語"), (8, "ÉMOU ÜLLO")]


def test_languages(spark):
    model = lid.fit(corpus(spark))
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in EDGES], "doc_id bigint, text string, score double")
    got = sorted([(r.doc_id, r.lang_pred) for r in lid.identify(docs, model).collect()], key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (5, "aa"), (5, "aa"), (6, "bb"), (7, got[6][1]), (8, "cc")], key=str)
    assert all(0 <= r.score <= 1 for r in lid.identify(docs, model).collect())
    kept = {r.doc_id for r in lid.accepted(docs, model).collect()}
    assert kept == {None, 5, 6, 8} and lid.accepted(docs, model).columns == docs.columns


def test_mask_holds_every_language(spark):
    model = lid.fit(corpus(spark))
    for k, lang in enumerate(model.languages):
        stream, _ = lid.letter_stream([WORDS[lang]])
        for n in lid.SIZES:
            h, real = lid.ngrams(stream, n)
            mask = np.bitwise_and.reduce([model.tables[0][r] for r in lid.rows_of(h[real])])
            assert ((mask >> k) & 1).mean() > 0.8


def test_ngrams_match_a_plain_count():
    stream, begins = lid.letter_stream(["Ab c", "", "ÉÉ"])
    assert "".join(map(chr, stream)) == " ab c  éé" and begins.tolist() == [0, 5, 6]


def test_many_languages_and_none(spark):
    rows = [(k, f"{chr(0x4E00 + k) * 3} {chr(0x4E00 + k)}", f"l{k:03d}") for k in range(100)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.tables) == 2
    assert model.predict([t for _, t, _ in rows])[0] == [x for _, _, x in rows]
    none = lid.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert none.predict(["abc"])[0] == ["und"]


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lid.identify(d, lid.fit(lid.training_rows(d))).join(d, "doc_id").where(lid.remainder(3) == 1)
    assert out.where("lang = lang_pred").count() > 0.97 * out.count()


def plain_grams(text):
    """n-grams of the text's letters with single blanks between words, by plain loops."""
    stream = " "
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            stream += low
        elif stream[-1] != " ":
            stream += " "
    return [stream[k : k + n] for n in lid.SIZES for k in range(len(stream) - n + 1) if stream[k : k + n].strip() and "  " not in stream[k : k + n]]


def test_scores_match_plain_loops(spark):
    model = lid.fit(corpus(spark))
    texts = ["bato kilo xygh", "Émou, üllo: 12 BATO!", "x", "日本 kilo", "ßoko\nruna teso"]
    got = model.score(texts)
    for text, row in zip(texts, got):
        # a blank follows every text but the last in the stream, where the next one begins: grams of one text only
        grams = plain_grams(text)
        want = np.zeros(len(model.languages))
        for n in lid.SIZES:
            own = [g for g in grams if len(g) == n]
            carried = np.zeros(len(model.languages))
            for g in own:
                h, real = lid.ngrams(np.array([ord(c) for c in g], np.uint32), n)
                assert real.all()
                mask = np.bitwise_and.reduce([model.tables[0][r[0]] for r in lid.rows_of(h)])
                carried += [int(mask) >> k & 1 for k in range(len(model.languages))]
            want += np.maximum(0, carried - len(own) * model.chance) / (1 - model.chance)
        one = model.score([text])[0]
        assert one[-1] == len(grams) and np.allclose(one[:-1], want)
        assert abs(row[-1] - one[-1]) <= 6 and abs(row[:-1] - one[:-1]).max() <= 6


def test_filters_hold_what_plain_counts_keep(spark):
    """Every n-gram that plain counts by language keep has its language's bit, and few others have."""
    rows = corpus(spark).collect()
    model = lid.fit(corpus(spark))
    counts = {lang: {} for lang in WORDS}
    for r in rows:
        for g in plain_grams(r.text):
            counts[r.lang][g] = counts[r.lang].get(g, 0) + 1
    total = {(lang, n): sum(c for g, c in own.items() if len(g) == n) for lang, own in counts.items() for n in lid.SIZES}
    share = {lang: {g: c / total[lang, len(g)] for g, c in own.items()} for lang, own in counts.items()}
    wrong = tried = 0
    for k, lang in enumerate(model.languages):
        for g in {g for own in counts.values() for g in own}:
            top = max(s.get(g, 0) for s in share.values())
            keep = share[lang].get(g, 0) >= max(lid.LEAST_SHARE, lid.LEAST_RATIO * top)
            h, _ = lid.ngrams(np.array([ord(c) for c in g], np.uint32), len(g))
            has = all(int(model.tables[0][r[0]]) >> k & 1 for r in lid.rows_of(h))
            assert has or not keep
            wrong, tried = wrong + (has and not keep), tried + 1
    assert wrong <= 0.01 * tried


def test_held_out_is_never_null(spark, tmp_path):
    from stratavec.llm import queries

    rows = [(None, "bato kilo", "aa"), (1, "bato kilo", "aa"), (2, "xygh zwqr", "bb"), (3, None, None), (4, "xygh", "bb")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op9_language_id", "op1_lm_scoring"):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 5 and all(r.held_out is not None for r in got)
