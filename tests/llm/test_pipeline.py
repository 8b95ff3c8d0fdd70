"""The pipeline's stages on a small table: what goes, what stays, and the packed tokens of what is left."""

import hashlib

import corpus_pipeline as C

WORDS = "the and of that with from this have which were their would there could other after first also made over".split()


def _docs(spark):
    import random

    r = random.Random(2)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.choice(["", "s", "ing", "ed"])) for _ in range(n))
    base = text(300)
    near = base.replace(base.split()[150], "changed", 1)
    secret = hashlib.sha1(b"x").hexdigest()
    rows = [(i, text(60), "en", "a") for i in range(40)]
    rows += [(100, base, "en", "a"), (101, base, "en", "b"), (102, near, "en", "c"), (103, None, "en", "c"), (104, "123 456 !!", "en", "c"), (105, "few words", "en", "c"), (106, "same five words again here " * 30, "en", "c")]
    rows += [(107, text(40) + f' token = "{secret}" ' + text(5), None, "d"), (108, text(30) + " *** ### $$$ %%% &&& ||| ### *** " * 9, "en", "d")]
    return spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long"), secret


def test_stages(spark, tmp_path):
    docs, secret = _docs(spark)
    kept = []
    for i, (name, stage) in enumerate(C.STAGES):
        before = docs.columns
        stage(spark, docs, "/none").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id for r in docs.collect()})
        if i + 1 < len(C.STAGES):
            assert docs.columns == before, name
    clean = set(range(40)) | {100, 107}
    assert kept[0] & {103, 104} == set() and clean | {105, 106, 108} <= kept[0]
    assert kept[1] & {105, 106, 108} == set() and clean | {101, 102} <= kept[1]
    assert kept[2] == clean == kept[3] == kept[4]
    text = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert secret not in text[107].text and "[SECRET]" in text[107].text and text[107].n_chars == len(text[107].text)
    whole = {}
    for r in docs.collect():
        whole[r.doc_id] = (whole.get(r.doc_id, (0, 0))[0] + r.length, r.doc_tokens)
    assert all(a == b for a, b in whole.values())


def test_language_stage_rejects_what_was_not_learned(spark):
    import random

    r = random.Random(3)
    syllables = {"en": "the ing tion and er wh", "de": "sch ung ein keit ß ü", "es": "ción ado ll ñ que os", "fr": "eau ment aille é ois ch"}
    text = lambda lang, n: " ".join("".join(r.choices(syllables[lang].split(), k=r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, r.randint(5, 60)), lang) for i, lang in enumerate(list(syllables) * 60)]
    clean = [text(lang, n) for lang in syllables for n in (1, 2, 3, 40)]
    foreign = ["Привет, как дела сегодня", "今天天气很好我们去公园", "καλημέρα τι κάνετε", "صباح الخير كيف حالك", "dzisiaj rano poszliśmy na targ kupić warzywa", "bu sabah taze ekmek almak için pazara gittik", "xqj vkzp wqxz jjvb pkq"]
    rows += [(1000 + i, t, None) for i, t in enumerate(clean)] + [(2000 + i, t, None) for i, t in enumerate(foreign)]
    for languages in (["de", "en", "es", "fr"], ["de", "en"], ["en"]):
        own = [x for x in rows if x[2] in languages or x[0] >= 2000 or (x[2] is None and list(syllables)[(x[0] - 1000) // 4] in languages)]
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
        kept = {x.doc_id for x in C.language_id(spark, docs, "/none").collect()}
        assert kept == {x[0] for x in own if x[0] < 2000}


def test_clashing_names_repeated_rows_and_null_ids(spark):
    docs, _ = _docs(spark)
    base = docs.filter("doc_id = 100").first().text
    more = [(100, base, "en", "a", 1), (200, base + " end", "en", "a", 1), (None, base, "en", "a", 1), (None, None, None, None, None), (201, "of the " + base + " " + base.upper() + " word" * 30_000, "en", "a", 1)]
    own = docs.union(spark.createDataFrame(more, docs.schema))
    own = own.selectExpr("*", "'p' AS lang_pred", "2.5D AS score", "'w' AS n_words", "'b' AS fail_bits", "7 AS start", "'f' AS findings", "'k' AS kept", "'c' AS component_id", "'h' AS part")
    kept = own
    for name, stage in C.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, "/none").collect(), own.schema)
        assert kept.columns == own.columns, name
    rows = kept.collect()
    assert {(r.lang_pred, r.score, r.n_words, r.fail_bits, r.start, r.findings, r.kept, r.component_id, r.part) for r in rows} == {("p", 2.5, "w", "b", 7, "f", "k", "c", "h")}
    ids = [r.doc_id for r in rows]
    assert ids.count(100) == 1 and ids.count(None) == 1 and not {101, 102, 200} & set(ids) and set(range(40)) <= set(ids)
    assert C.STAGES[-1][1](spark, kept, "/none").filter("doc_id IS NULL").count() > 0


def test_empty(spark):
    docs = _docs(spark)[0].limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, "/none").count() == 0
