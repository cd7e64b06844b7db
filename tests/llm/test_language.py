from pyspark.sql import functions as F

from labelproof.llm import language
from labelproof.llm.common import held_out


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = language.dictionaries(docs)
    assert set(content) == {"en", "fr", "de", "es"} and all(len(c) <= language.DICTIONARY for c in content.values())
    rows = language.predicted(docs.filter(held_out(F.col("doc_id"))), content)
    assert rows.filter("lang = lang_pred").count() >= 0.97 * rows.count()


def test_odd_rows(odd, none, docs):
    content = language.dictionaries(docs)
    rows = language.predicted(odd.withColumn("score", F.lit("clash")), content).collect()
    for row in rows:
        letters = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == (not letters) and 0 <= row["score"] <= 1
    assert language.predicted(none, content).count() == 0 and language.dictionaries(none) == {}
    assert {r["lang_pred"] for r in language.predicted(odd, {}).collect()} == {"und"}
    assert [language.Judge({"x": b"abc"})("abc")[0]] == ["x"]


def test_whole_texts_count():
    content = {"a": b"alpha beta gamma delta " * 50, "b": b"uno dos tres cuatro cinco " * 50}
    judge = language.Judge(content)
    assert judge("alpha beta gamma " * 5 + "cuatro dos tres uno " * 5000)[0] == "b"


def test_texts_without_a_letter_are_undetermined():
    judge = language.Judge({"en": b"the quick brown fox " * 40, "fr": b"le renard brun et vif " * 40})
    assert all(judge(t)[0] == "und" for t in (None, "", " ", "123 456", "½ ²", "Ⅷ Ⅸ", "_ - !"))
    assert judge("Ⅷ the quick fox")[0] == "en"


def test_every_block_goes_to_the_smallest_of_all_dictionaries():
    import zstandard

    content = {"en": b"the quick brown fox jumps over it " * 60, "fr": b"le renard brun saute par dessus tout " * 60, "de": b"der schnelle braune fuchs springt " * 60}
    judge = language.Judge(content)
    for text in ("the fox jumps " * 500, "der fuchs springt und der renard", "le renard saute", "zzz qqq " * 3000, "brown fuchs tout"):
        sizes = {}
        for level in (language.LEVEL, language.STRONG):
            data = language.letters(text)
            for name, held in content.items():
                known = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=level)
                one = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False)
                blocks = [data[i : i + language.BLOCK] for i in range(0, len(data), language.BLOCK)]
                sizes[level, name] = sum(len(one.compress(b)) for b in blocks)
        best = {level: sorted((sizes[level, n], i) for i, n in enumerate(sorted(content))) for level in (language.LEVEL, language.STRONG)}
        narrow = (best[language.LEVEL][1][0] - best[language.LEVEL][0][0]) / best[language.LEVEL][1][0] < language.NARROW
        used = best[language.STRONG if narrow else language.LEVEL]
        assert judge(text)[0] == sorted(content)[used[0][1]]
