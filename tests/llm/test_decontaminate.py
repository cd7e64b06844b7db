from pyspark.sql import functions as F

from labelproof.llm import decontaminate

ITEM = "Today the farmer Miller sold 12 kg of apples to his neighbour Baker for 30 dollars and then gave 12 pears to the old school nearby."
OTHER = "A quiet river runs through the long valley where nobody has built a house since the last great flood came down."


def pairs(spark, texts, items=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items if items is not None else [(7, ITEM), (8, OTHER), (9, "too short here"), (10, None), (11, "")], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}


def test_templates(spark):
    rows = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    tokens = decontaminate.templates(rows, "doc_id", "text").first()["tokens"]
    assert tokens[:10] == ["today", "the", "farmer", "#name", "sold", "#num", "#unit", "of", "apples", "to"] and "#unit" in tokens[10:]


def test_copies_and_other_parameters_are_caught(spark):
    changed = ITEM.replace("Miller", "Smith").replace("12", "45").replace("30", "77").replace("Baker", "Weaver")
    mixed = changed.replace("gave 45", "gave 46")
    texts = [f"Some words before. {ITEM} And after.", f"x {changed} y", f"x {mixed} y", OTHER, OTHER.lower(), "Nothing of that kind is here. " * 40, None, "", "And so too short here it is"]
    got = pairs(spark, texts)
    assert (0, 7) in got and got[0, 7]["consistent"] and got[1, 7]["consistent"] and got[1, 7]["slot_values"] > 0
    # 12 stands for two values here, and what remains without slots isn't half of the item.
    assert (2, 7) not in got
    assert (3, 8) in got and (4, 8) in got and (8, 9) in got and {d for d, _ in got} == {0, 1, 3, 4, 8}


def test_passages_of_fifty_words_in_long_items(spark):
    item = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    passage = " ".join(item.split()[100:160])
    got = pairs(spark, [f"start {passage} end", " ".join(item.split()[100:120])], [(1, item)])
    assert set(got) == {(0, 1)}


def test_odd_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    again = spark.createDataFrame([(5, ITEM), (5, ITEM), (None, ITEM)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["matched"]) for r in decontaminate.contaminated(again, bench).collect())[0][0] == "5"
    assert decontaminate.contaminated(again, bench).count() == 2


def test_only_built_in_functions(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontaminate.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_each_occurrence_is_judged_by_itself(spark):
    changed = ITEM.replace("Miller", "Smith").replace("12", "45").replace("30", "77").replace("Baker", "Weaver")
    mixed = changed.replace("gave 45", "gave 46")
    drill = "the child has 4 red apples in a bag and the child has 9 red apples in a bag"
    got = pairs(spark, [f"{ITEM} {changed}", f"{ITEM} Then the farmer Cook sold 9 kg of apples to his neighbour Fox", drill, f"{mixed} {mixed}"], [(7, ITEM), (8, drill)])
    assert set(got) == {(0, 7), (1, 7), (2, 8)} and all(r["consistent"] and r["matched"] == r["windows"] for r in got.values())


def test_other_case_and_other_line_ends(spark):
    changed = ITEM.replace("Miller", "Smith").replace("12", "45").replace("30", "77").replace("Baker", "Weaver")
    wrapped = [t.replace("farmer ", "farmer\n").replace("neighbour ", "neighbour\n").replace("of ", "of\n") for t in (ITEM, changed)]
    got = pairs(spark, [f"x {ITEM.lower()} y", f"x {ITEM.upper()} y", *wrapped, f"Question:\n{changed}"], [(7, ITEM)])
    assert set(got) == {(i, 7) for i in range(5)}


def test_items_of_numbers_and_names_meet_their_copies(spark):
    numbers, names = "3 5 8 12 17 23 30 38 47", "Present were Miller Baker Smith Weaver Cook Fox Carter Mason and Turner"
    got = pairs(spark, [f"the sequence {numbers} goes on", names, numbers.replace("3 5", "4 6").replace("17", "18")], [(7, numbers), (8, names)])
    assert set(got) == {(0, 7), (1, 8)} and all(r["matched"] == r["windows"] for r in got.values())


def test_near_copies_and_shorter_passages(spark):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))
    short = "which metal melts at the lowest heat of all that people ever dug up today"
    grown = OTHER.replace("built a", "ever yet built any old")
    texts = [" ".join(long.split()[50:95]), short.replace("heat", "warmth"), grown, OTHER.replace("runs", "winds").replace("nobody", "no-one"), " ".join(short.split()[:9])]
    got = pairs(spark, texts, [(7, long), (8, short), (9, OTHER)])
    assert set(got) == {(0, 7), (1, 8), (2, 9), (3, 9)} and all(r["consistent"] for r in got.values())


def test_a_shared_opening_makes_no_pairs(spark, monkeypatch):
    """Items and documents that have only a common opening: none is paired with all the others."""
    opening = "which of the following is"
    words = lambda side, i: " ".join(f"{side}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}" for k in range(20))
    written, counts = decontaminate.written, {}

    def counting(frame, name):
        kept = written(frame, name)
        counts[name] = kept.count()
        return kept

    monkeypatch.setattr(decontaminate, "written", counting)
    items = [(i, f"{opening} {words('q', i)}") for i in range(200)]
    texts = [f"{opening} {words('d', i)}" for i in range(200)] + [items[7][1]]
    assert set(pairs(spark, texts, items)) == {(200, 7)}
    assert counts["pairs"] == 1 and counts["met"] <= 30
