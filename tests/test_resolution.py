"""Behaviour of the resolution engine on small fixtures, and its kernels against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import attributes, numbers, similarity, text
from tallyweave.operators import clean, layout, results
from tallyweave.plans import catalogue as plan_catalogue
from tallyweave.plans import resolve
from tallyweave.plans.session import COLUMNS, Engine
from tallyweave.sources import config, sheets

CFG = config.load_config()


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "v string").select(*[c(F.col("v")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("raw, expected", [
    ("ﻣﻬﺘﺎﺑﯽ", "مهتابی"), ("مهتاƬی", "مهتابی"), ("باطري", "باتری"), ("LED  9-W", "led9w"), ("می‌شود", "می شود"), (None, ""), ("  ", ""), ("پنل (۱۲)", "پنل 12"), ("sc - 40 w", "sc40w"),
])
def test_normalised_names(spark, raw, expected):
    assert one(spark, raw, text.normalize) == expected == text.py_normalize(raw)


def test_codes_families_and_scripts(spark):
    assert one(spark, "SCAP-42/S2", text.code_key) == "SCAP42S2" and one(spark, "00120", text.code_key) == "120" and one(spark, "000", text.code_key) == "0"
    assert one(spark, "SCAP42", text.code_family) == "SCAP"
    assert one(spark, "وات15ردار2,200", text.split_scripts) == "وات 15 ردار 2,200"
    assert one(spark, "a b c", text.words_and_pairs) == ["a", "b", "c", "ab", "bc"] and one(spark, "", text.words_and_pairs) == []
    assert one(spark, "کارتن", text.unit_name) == "box" and one(spark, "xyz", text.unit_name) == "xyz"


@pytest.mark.parametrize("raw, expected", [("1,250,000", 1250000), ("1.250", 1250), ("12,5", 12.5), ("-5", 5), ("1.250,50", 1.2505), ("12 345", 12345), ("۱٬۲۵۰٬۰۰۰", 1250000), ("none", None), (None, None)])
def test_numbers(spark, raw, expected):
    assert one(spark, raw, numbers.parse_number) == expected


def test_prices_are_shown_and_bounded(spark):
    rows = spark.createDataFrame([(1234567.0,), (2.5,), (None,)], "v double").select(numbers.format_price(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["1,234,567", "2.50", "-"]
    assert one(spark, "500", lambda c: numbers.parse_price(c, 1000, 2000)) is None and one(spark, "a 3 b 4,5", numbers.find_numbers) == [3.0, 4.5]


def test_specifications(spark):
    s = lambda t: one(spark, t, attributes.specs)
    assert s("پنل ۹ وات").watt == 9 and s("وات15").watt == 15
    r = s("کلید مینیاتوری 6 تا 32 آمپر")
    assert r.amp == 6 and (r.amp_range.lo, r.amp_range.hi) == (6, 32)
    assert s("16 آ مپر").amp == 16 and s("SC40A").amp is None
    assert 600.0 in s("60 سانت").mm and s("60 سانت").cm == 60
    assert s("sc40w").watt == 0 and s("new 5").watt == 5 and s("IP20").ip is None and s("IP 20").ip == 20
    assert s("141,000").numbers == [0, 141] and s("30x60").dims == [30, 60]


def test_codes_brands_and_wording_of_names(spark):
    codes = lambda t: one(spark, t, attributes.model_codes)
    assert codes("پنل شیله (SCAP)") == ["SCAP"] and codes("(SCTRW/B)") == ["SCTRWB"] and codes("LED E27 SMD") == []
    assert one(spark, "پنل شی له", attributes.brand_of) == "شیله" and one(spark, "other", attributes.brand_of) == ""
    wide = one(spark, "کلید محافظ جان تک فاز", attributes.expand_wording)
    assert wide.endswith("تک پل دو پل")
    assert one(spark, "red", lambda c: attributes.expand_wording(c, {}, [])) == "red"


def naive_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


def test_similarities_match_brute_force():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(rng.randint(0, n)))
    for _ in range(150):
        a, b = word(12), word(20)
        assert similarity.lcs(a, b) == naive_lcs(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            tries = [(short, long), (long, short)] if len(short) == len(long) else [(short, long)]
            best = max(similarity.py_ratio(x, y[max(0, e - len(x)) : e]) for x, y in tries for e in range(1, len(y) + len(x)))
            assert similarity.py_partial_ratio(a, b) == pytest.approx(best)
    assert similarity.py_partial_ratio("x" * 70 + "y", "z" + "x" * 90) == pytest.approx(max(similarity.py_ratio("x" * 70 + "y", "x" * n) for n in range(60, 72)))
    assert similarity.py_token_set_ratio("cat6 sftp", "cat6") == 100 and similarity.py_name_similarity("cat6", "cat6 sftp") < 100
    assert similarity.py_ratio("tide", "diet") == 50 and similarity.py_ratio("", "a") == 0


def products(words, **over):
    return layout.page_products(words, config.load_config(over=over))


def test_rows_group_by_their_first_word(spark):
    assert [len(r) for r in layout.visual_rows([(y, 0, 1, "w") for y in (100, 102, 104, 106)], 3.5)] == [2, 2]
    ys = spark.createDataFrame([("d", float(y)) for y in (100, 102, 104, 106, 130)], "doc string, y double")
    assert [r.group for r in layout.anchor_rows(ys, ["doc"], "y", 3.5).orderBy("y").collect()] == [0, 0, 1, 1, 2]


def test_products_of_a_page():
    row = lambda y, code, *rest: [(y, 540.0, 580.0, code), *rest]
    price = lambda y, t="297,000": (y, 115.0, 150.0, t)
    assert products(row(100, "SC-120", (100, 400.0, 440.0, "12وات"), price(100))) == [("SC-120", 297000.0, "12وات 297,000", "", "")]
    assert products(row(100, "SCX-1", (100, 300.0, 320.0, "1200"), price(100, "1,640,000")))[0][1] == 1640000
    assert products([*row(100, "SCWLS-2835", price(100)), (109, 540.0, 560.0, "120")])[0][0] == "SCWLS-2835-120"
    assert products([*row(100, "SCWLS-2835", price(100)), (108, 540.0, 560.0, "Flicker")])[0][0] == "SCWLS-2835"
    assert products([*row(100, "SC-9"), (105, 115.0, 150.0, "950,000")])[0][:2] == ("SC-9", 950000.0)
    assert products(row(100, "SC-9")) == [] and products([(100, 500.0, 510.0, "3"), price(100)]) == []
    split = [(100, 115.0 + 8 * i, 122.0 + 8 * i, t) for i, t in enumerate(["1", "،", "699", "،", "000"])]
    assert products(row(100, "SC-1", *split))[0][1] == 1699000
    codes = [(y, 540.0, 580.0, f"SC-{y}") for y in (100, 140, 180)]
    data = [w for y in (118, 155, 200) for w in ((y, 400.0, 450.0, "لامپ"), price(y))]
    assert [p[0] for p in products(codes + data)] == ["SC-100", "SC-140", "SC-180"]
    assert [p[0] for p in products(codes[:2] + data) if p[0]] == []


def test_wattage_column_and_sections():
    head = [(50, 500.0, 530.0, "مدل"), (50, 300.0, 320.0, "توان"), (50, 100.0, 130.0, "قیمت")]
    line = lambda y, *watts: [(y, 480.0, 520.0, "لامپ"), *[(y, x, x + 10.0, w) for x, w in watts], (y, 400.0, 430.0, "100"), (y, 100.0, 130.0, "1,800,000")]
    assert products(head + line(80, (305.0, "7")))[0][2].endswith("7 وات")
    assert "وات" not in products(head + line(80, (308.0, "7"), (298.0, "9")))[0][2] and "وات" not in products(line(80, (305.0, "7")))[0][2]
    title = [(20, 300.0, 380.0, "چراغ‌های سقفی"), (20, 250.0, 290.0, "Ceiling")]
    assert products([*title, (60, 540.0, 580.0, "SC-1"), (60, 115.0, 150.0, "50,000")])[0][3:] == ("چراغ‌های سقفی", "Ceiling")
    assert layout.line_products(["7 141,000 لامپ حبابی"], CFG)[0][1] == 7141


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [
        (0, "SCAP-7", 141000.0, "پنل اس ام دی", "7 وات شیله"), (1, "SCAP-9", 177000.0, "پنل اس ام دی", "9 وات شیله"), (2, "SCAP-12", 297000.0, "پنل اس ام دی", "12 وات شیله"),
        (3, "VSMCB-1C", 900000.0, "کلید مینیاتوری", "تک پل 6 تا 32 آمپر ویسنا"), (4, "VSMCB-40", 1100000.0, "کلید مینیاتوری", "تک پل 40 آمپر ویسنا"), (5, "SCUNIQ-55", 500000.0, "", "لامپ ویژه شیله"),
    ]
    df = spark.createDataFrame([(*r, "", 1, 0) for r in rows], "price_id long, code string, price double, section_fa string, text string, section_en string, page int, list_ord int")
    return layout.finalize(df).cache()


def matched(spark, catalogue, names, **over):
    cfg = config.load_config(over=over)
    stock = spark.createDataFrame([(i, i, "1", n, 1.0, "") for i, n in enumerate(names)], "item_id long, row int, code string, name string, stock double, unit string")
    out = resolve.resolve(clean.clean_inventory(clean.prepare_inventory(stock, cfg)), catalogue, cfg)
    return [r for r in out.orderBy("item_id").collect()]


def test_matching_prefers_ratings_and_vetoes_conflicts(spark, catalogue):
    names = ["لامپ ویژه شیله SCUNIQ-55", "پنل اس ام دی 9 وات شیله (SCAP)", "پنل اس ام دی 33 وات شیله (SCAP)", "کلید مینیاتوری تک فاز 16 آمپر ویسنا", "کلید مینیاتوری تک فاز 40 آمپر ویسنا", "پنل 9 وات دیگر"]
    out = matched(spark, catalogue, names)
    assert (out[0].price, out[0].status, out[0].score, out[0].match_type) == (500000.0, "EXACT", 100.0, "exact_code")
    assert out[1].price == 177000.0 and out[2].price is None and out[2].status == "NOT_FOUND"
    assert out[3].price == 900000.0 and out[4].price == 1100000.0
    assert out[5].price is None and out[5].score == 0 and out[5].note
    assert [r.price for r in matched(spark, catalogue, names[:2], target_brand="ویسنا")] == [None, None]
    assert len(out) == len(names)


def test_partitioning_does_not_change_results(spark, catalogue):
    names = [f"پنل اس ام دی {w} وات شیله (SCAP)" for w in (7, 9, 12)] * 3
    first = matched(spark, catalogue, names)
    assert first == matched(spark, catalogue.repartition(7), names)


def test_equal_names_are_matched_once(spark, catalogue, monkeypatch):
    names = [f"پنل اس ام دی {w} وات شیله (SCAP)" for w in (7, 9, 12)]
    single, met, top = matched(spark, catalogue, names), [], resolve.C.top_candidates

    def counted(hits, *more):
        met.append(hits.select("item_id").distinct().count())
        return top(hits, *more)

    monkeypatch.setattr(resolve.C, "top_candidates", counted)
    out = matched(spark, catalogue, names * 20)
    assert met == [3] and [r.item_id for r in out] == list(range(60))
    assert all(r.asDict() == single[r.item_id % 3].asDict() | {"item_id": r.item_id} for r in out)


def test_equal_price_rows_are_derived_once(spark):
    rows = [(i, 0, "AB-1", "lamp", None, None, price) for i, price in ((4, 50.0), (3, 500.0), (1, 5.0), (2, 600.0))] + [(9, 1, "AB-1", "lamp", None, None, 70.0)]
    raw = spark.createDataFrame(rows, "price_id long, list_ord int, code string, text string, section_fa string, section_en string, price double")
    assert sorted(r.price_id for r in clean.first_of_equal(raw, 10, 1000, ["list_ord"]).collect()) == [2, 9]
    kept = [clean.clean_prices(layout.finalize(r), 10, 1000, ["list_ord"]) for r in (raw, clean.first_of_equal(raw, 10, 1000, ["list_ord"]))]
    assert sorted(map(str, kept[0].collect())) == sorted(map(str, kept[1].collect()))


def test_engine_end_to_end(spark, tmp_path):
    words = [("a.pdf", 1, float(y), x0, x0 + 40, t) for y, code, watt, price in ((100, "SCAP-7", "7", "141,000"), (130, "SCAP-9", "9", "177,000"), (160, "SCAP-12", "12", "297,000"))
             for x0, t in ((450.0, code), (380.0, "پنل"), (300.0, f"{watt}وات"), (80.0, price))]
    frame = spark.createDataFrame(words, "doc_id string, page int, y double, x0 double, x1 double, text string")
    sheet = str(tmp_path / "stock.xlsx")
    rows = [{"c": 1001, "n": "پنل 7 وات شیله SCAP-7", "s": 5}, {"c": 1002, "n": "پنل 12 وات شیله SCAP-12", "s": None}, {"c": "1003", "n": "پنل 9 وات دیگران", "s": 2.5}]
    sheets.write_sheet(iter(rows), [("c", "کد کالا"), ("n", "نام کالا"), ("s", "موجودی")], sheet)
    engine = Engine(spark)
    engine.add_words(frame.limit(0), "empty", "شیله")
    engine.add_words(frame, "first", "شیله")
    engine.read_inventory(sheet)
    out = engine.run().orderBy("item_id").collect()
    assert [(r.code, r.stock, r.price, r.source) for r in out] == [("1001", 5.0, 141000.0, "first"), ("1002", None, 297000.0, "first"), ("1003", 2.5, None, "")]
    assert [r["ok"] for r in engine.report] == [False, True] and engine.stats["priced"] == 2 and engine.report[1]["priced"] == 2
    assert engine.results("priced", "scap-12").count() == 1 and engine.results("out_of_stock").count() == 1
    path = engine.export(str(tmp_path / "out.xlsx"), only_priced=True)
    back = list(itertools.islice(sheets.sheet_rows(path), 5))
    assert back[0] == [label for _, label in COLUMNS] and [r[0] for r in back[1:]] == [1001, 1002]
    with pytest.raises(config.AppError):
        Engine(spark).run()


def test_sheets_without_known_columns_are_refused(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(config.ExcelError):
        sheets.read_inventory(spark, str(path))
    path.write_text("junk\nItem Code,Product Name,Qty\n7,Lamp,\"1,250\"\n,,3\n")
    row = sheets.read_inventory(spark, str(path)).collect()
    assert [(r.row, r.code, r.name, r.stock) for r in row] == [(3, "7", "Lamp", 1250.0)]


def test_filters_refuse_unknown_names(spark):
    with pytest.raises(ValueError):
        results.filter_results(spark.range(1), "other")


def test_config_merges(tmp_path):
    path = str(tmp_path / "c.json")
    config.save_config(path, {"weights": {"code": 0.5}})
    assert config.load_config(path)["weights"] == {"code": 0.5, "spec": 0.25, "text": 0.30}
    (tmp_path / "c.json").write_text("{")
    assert config.load_config(path) == config.DEFAULTS


def test_entry_lists_queries_and_sql(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_query_reads_the_whole_price_list(spark, tmp_path):
    kinds = ["COPPER", "BRASS", "NICKEL", "STEEL", "TIN", "ZINC"]
    parts = [(3 * i, f"item{i} piece{i}", kinds[i - 1], 10 + i, "Brand#1", 1000.0 + i) for i in range(1, 7)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(3, 5.0)], "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = {r.item_id: (r.list_ord, r.pdf_code, r.price) for r in plan_catalogue.resolve_prices(spark, str(tmp_path)).collect()}
    assert out == {key: (0, f"{kind}-{size}", price) for key, _, kind, size, _, price in parts}


def test_one_failing_list_does_not_stop_the_others(spark, tmp_path):
    words = [("a", 1, 100.0, 540.0, 590.0, "AB-12"), ("a", 1, 100.0, 300.0, 340.0, "lamp"), ("a", 1, 100.0, 100.0, 140.0, "141,000")]
    spark.createDataFrame(words, "doc_id string, page int, y double, x0 double, x1 double, text string").write.parquet(str(tmp_path / "good"))
    (tmp_path / "broken.pdf").write_bytes(b"no such file type")
    items = spark.createDataFrame([(1, 1, "1", "lamp AB-12", 3.0, "")], "item_id long, row int, code string, name string, stock double, unit string")
    said = []
    engine = Engine(spark, {"restrict_to_price_list_brands": False, "scanned_char_threshold": 1}, progress=lambda percent, message: said.append(percent))
    engine.add_path("  ")
    engine.add_path(str(tmp_path / "missing"), label="first")
    engine.add_path(str(tmp_path / "broken.pdf"), kind="pdf", label="second")
    engine.add_path(str(tmp_path / "good"), label="third")
    engine.set_inventory(items)
    assert [r.price for r in engine.run().collect()] == [141000.0]
    assert [(r["label"], r["ok"], r["pdf_rows"]) for r in engine.report] == [("first", False, 0), ("second", False, 0), ("third", True, 1)]
    assert all(r["error"] for r in engine.report[:2]) and all(r["seconds"] >= 0 for r in engine.report)
    assert said == sorted(said) and said[-1] == 100
    engine.reset()
    engine.add_path(str(tmp_path / "missing"), label="first")
    engine.set_inventory(items)
    with pytest.raises(config.AppError, match="no price list"):
        engine.run()
    with pytest.raises(config.AppError):
        Engine(spark, brands_required=True).add_path("list.parquet")


def test_the_command_line_tells_a_failure(tmp_path, spark, capsys):
    from tallyweave.plans import cli

    (tmp_path / "stock.csv").write_text("code,name,stock\n1,lamp,2\n", encoding="utf-8")
    assert cli.main(["--words", str(tmp_path / "none"), "--inventory", str(tmp_path / "stock.csv"), "--out", str(tmp_path / "out.xlsx")]) == 2
    assert "no price list could be read" in capsys.readouterr().err


def test_oversized_numbers_are_no_crash(spark):
    from tallyweave.functions import attributes
    from tallyweave.operators import score

    names = spark.createDataFrame([("box 99999999999999999999x40", "99999999999 w"), ("20x40x20", "7 w")], "a string, b string")
    rows = names.select(attributes.specs(F.col("a")).alias("a"), attributes.specs(F.col("b")).alias("b"))
    assert [r.d for r in rows.select(F.col("a.dims").alias("d")).collect()] == [[40], [20, 40]]
    assert rows.select(score.spec_verdict(F.col("b"), F.col("a")).alias("v")).select("v.conflicts").collect()[0].conflicts == 0


def test_settings_are_layered():
    base, over = {"a": {"b": 1, "c": {"d": 2}}, "e": [1], "x": 0}, {"a": {"c": {"d": 3, "f": 4}}, "e": {"g": 5}, "x": {}}
    assert config.layered(base, over) == {"a": {"b": 1, "c": {"d": 3, "f": 4}}, "e": {"g": 5}, "x": {}}
    assert config.layered({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}} and config.layered() == {}
