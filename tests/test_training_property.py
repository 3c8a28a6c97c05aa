"""Property test: the training frame equals a brute-force computation of the
same semantics on small random inputs (duplicates, unknown companies, other
genders, nulls, bad counts included)."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from giftlens.operators import training as TR

COMPANIES = ["c1", "c2", "c3"]
SHOPS = ["s1", "s2"]
GIFTS = ["g1", "g2", "g3", "g4"]
PRODUCTS = ["product_main_category", "product_sub_category", "product_brand", "product_color",
            "product_durability", "product_target_gender", "product_utility_type", "product_type"]


def brute_force(sel, cat, emp):
    def num(v):
        try:
            x = float(v)
            return 0.0 if x != x else x
        except (TypeError, ValueError):
            return 0.0

    def clean(v):
        return "NONE" if v is None else v.strip('"').strip()

    events = sorted(sel, key=lambda r: r["seq"])
    first_emp = {}
    for e in emp:
        first_emp.setdefault(e[0], (num(e[1]), num(e[2])))
    groups, firsts = {}, {}
    for r in events:
        key = (r["shop_id"], r["company_cvr"], r["gift_id"], r["employee_gender"].lower())
        g = groups.setdefault(key, {"n": 0, "p": {}})
        g["n"] += 1
        for c in PRODUCTS:
            g["p"].setdefault(c, clean(r[c]))
        firsts.setdefault(r["gift_id"], {c: clean(r[c]) for c in PRODUCTS})
    out = []
    for (shop, comp, gift, gender), g in groups.items():
        if gender not in ("male", "female") or comp not in first_emp:
            continue
        exp = first_emp[comp][0 if gender == "male" else 1]
        out.append((shop, comp, gift, gender, g["n"], exp, g["n"] / exp if exp > 0 else 0.0,
                    *[g["p"][c] for c in PRODUCTS]))
    for e in emp:
        for shop, gift in cat:
            for gi, gender in enumerate(("male", "female")):
                if (shop, e[0], gift, gender) in groups:
                    continue
                f = firsts.get(gift, {c: "NONE" for c in PRODUCTS})
                out.append((shop, e[0], gift, gender, 0, num(e[1 + gi]), 0.0, *[f[c] for c in PRODUCTS]))
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out)


event = st.fixed_dictionaries({
    "shop_id": st.sampled_from(SHOPS), "company_cvr": st.sampled_from(COMPANIES + ["c9"]),
    "gift_id": st.sampled_from(GIFTS), "employee_gender": st.sampled_from(["male", "female", "MALE", "unisex"]),
    **{c: st.sampled_from(["a", "b", None, ' "q" ']) for c in PRODUCTS},
})


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(events=st.lists(event, min_size=1, max_size=12),
       cat=st.lists(st.tuples(st.sampled_from(SHOPS), st.sampled_from(GIFTS)), min_size=1, max_size=6),
       emp=st.lists(st.tuples(st.sampled_from(COMPANIES), st.sampled_from(["0", "3", "7", "x", None]),
                              st.sampled_from(["2", "5", "nan", ""])), min_size=1, max_size=4))
def test_training_frame_matches_brute_force(spark, events, cat, emp):
    sel = [dict(e, seq=i) for i, e in enumerate(events)]
    cols = ["shop_id", "company_cvr", "employee_gender", "gift_id"] + PRODUCTS
    sel_df = spark.createDataFrame([tuple(r[c] for c in cols) + (r["seq"],) for r in sel],
                                   ", ".join(f"{c} string" for c in cols) + ", event_seq long")
    cat_df = spark.createDataFrame(cat, "shop_id string, gift_id string")
    emp_df = spark.createDataFrame([(c, "b", m, f, i) for i, (c, m, f) in enumerate(emp)],
                                   "company_cvr string, branch_code string, male_count string, "
                                   "female_count string, emp_seq long")
    links = spark.createDataFrame([(c, s) for c in COMPANIES for s in SHOPS], "company_cvr string, shop_id string")
    tf = TR.training_frame(sel_df, cat_df, emp_df, links=links, employees_order="emp_seq", materialize=False)
    got = Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in tf.collect())
    assert got == brute_force(sel, cat, emp)
