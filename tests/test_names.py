from giftlens.operators import names as N

CASES = [("FREJA HANSEN", "Freja", "female", "high", "danish_dict"),
         ("bo jensen", "Bo", "male", "high", "danish_dict"),
         ("Anne-Marie Hansen", "Anne-Marie", "unisex", "low", "fallback"),
         ("GUNHILD SØRENSEN", "Gunhild", "unisex", "low", "fallback"),
         ("Julie Østby-Svendsen", "Julie", "unisex", "low", "fallback"),
         ("", "", "unisex", "low", "fallback")]


def test_builtin_list_only(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, name string")
    got = {r.i: (r.normalized_name, r.gender, r.confidence, r.method)
           for r in N.classify_gender(df).collect()}
    for i, (_, norm, g, conf, method) in enumerate(CASES):
        assert got[i] == (norm, g, conf, method), CASES[i]


def test_name_table_cascade(spark):
    table = spark.createDataFrame([("Anne-Marie", "any", "female"), ("John", "any", "male"),
                                   ("Andy", "any", "andy"), ("Magnus", "any", "mostly_male"),
                                   ("Gunhild", "denmark", "female")], "name string, country string, label string")
    df = spark.createDataFrame([(0, "Anne-Marie Hansen"), (1, "Magnus Ebenstrand"), (2, "Andy Kim"),
                                (3, "GUNHILD SØRENSEN"), (4, " clara  Lund ")], "i int, name string")
    got = {r.i: (r.gender, r.confidence, r.method) for r in N.classify_gender(df, table).collect()}
    assert got[0] == ("female", "high", "gender_guesser")
    assert got[1] == ("male", "high", "danish_dict")   # built-in list precedes "mostly"
    assert got[2] == ("male", "low", "gender_guesser")
    assert got[3] == ("female", "medium", "gender_guesser")
    assert got[4] == ("female", "high", "danish_dict")


def test_counts_and_confidence(spark):
    df = spark.createDataFrame([("c1", "Freja"), ("c1", "Bo"), ("c1", "Zed"), ("c2", "Emil")],
                               "company_cvr string, name string")
    cl = N.classify_gender(df)
    counts = {r.company_cvr: (r.male_count, r.female_count) for r in N.gender_counts(cl).collect()}
    assert counts == {"c1": (1, 1), "c2": (1, 0)}
    conf = N.gender_confidence(cl).first()
    assert (conf.high, conf.medium, conf.low) == (3, 0, 1)
