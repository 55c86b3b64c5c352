from nichewright.llm import mixing


def test_plan_counts_the_copies_of_a_mix_in_training_order(spark, monkeypatch):
    made = {}

    def kept(df, label, own=mixing.materialise):
        made[label] = own(df, label)
        return made[label]

    monkeypatch.setattr(mixing, "materialise", kept)
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(900)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mix = made["mix-order"].selectExpr("*", "_metadata.file_name AS file").collect()
    files = [[r["__nw_position"] for r in mix if r["file"] == f] for f in sorted({r["file"] for r in mix})]
    assert len(files) > 1 and sum(files, []) == sorted(r["__nw_position"] for r in mix)
    assert sum(r.taken for r in plan) == sum(r["__nw_size"] for r in mix) and sum(r.copies for r in plan) == len(mix)
