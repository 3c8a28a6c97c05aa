import json
import tempfile

from giftlens import workflows as W


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_train_and_predict_from_files(spark):
    d = tempfile.mkdtemp(prefix="gl-wf-")
    header = ("shop_id,company_cvr,employee_gender,gift_id,product_main_category,product_sub_category,"
              "product_brand,product_color,product_durability,product_target_gender,product_utility_type,"
              "product_type\n")
    rows = []
    for c in range(10):
        for g in range(6):
            for k in range((c + g) % 3 + 1):
                gender = "male" if (k + g) % 2 else "female"
                rows.append(f"shop{c % 2},{10000000 + c},{gender},gift{g},Cat{g % 3},Sub,Brand{g % 2},NONE,"
                            f"durable,unisex,practical,individual")
    _write(f"{d}/sel.csv", header + "\n".join(rows) + "\n")
    _write(f"{d}/cat.csv", "shop_id,gift_id\n" + "\n".join(f"shop{s},gift{g}" for s in range(2) for g in range(8)) + "\n")
    _write(f"{d}/emp.csv", "company_cvr,branch_code,male_count,female_count\n"
           + "\n".join(f"{10000000 + c},1,{5 + c},{7 + c}" for c in range(10)) + "\n")
    report = W.train_from_files(spark, f"{d}/sel.csv", f"{d}/cat.csv", f"{d}/emp.csv", f"{d}/model",
                                max_iter=3).first()
    assert report.training_companies == 10 and report.training_records > 0
    reqs = [{"cvr": "10000001", "male_count": 6, "female_count": 8,
             "presents": [{"id": "gift1", "description": "pizza oven"}, {"id": "gift2", "description": "bag"}]},
            {"cvr": "123", "male_count": 1, "female_count": 1, "presents": [{"id": "x", "description": "y"}]}]
    _write(f"{d}/req.json", "\n".join(json.dumps(r) for r in reqs) + "\n")
    preds, checked = W.predict_from_files(spark, f"{d}/req.json", f"{d}/model")
    assert preds.count() == 2
    assert sorted(r.is_valid for r in checked.collect()) == [False, True]
    rules, _ = W.predict_from_files(spark, f"{d}/req.json", None)
    assert {r.product_id for r in rules.collect()} == {"gift1", "gift2"}
