import math

from pyspark.sql import functions as F

from finlattice.functions import text as X


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_parse_value(spark):
    cases = {"$1,234.56": 1234.56, "(123)": -123, "12.3%": 12.3, "N/A": None, "--": None, "—": None, "$(1,234)": None, "($5)": -5, "(-5)": 5, "1 234": 1234, "0": 0, "": None, "1e5": 100000, "1d": None, "CAD 5": None, "1_000": None, " 7 ": 7}
    assert values(spark, list(cases), X.parse_value) == list(cases.values())
    assert math.isnan(values(spark, ["nan"], X.parse_value)[0])


def test_stem(spark):
    cases = {"vaccinations": "vaccin", "boarding": "board", "exams": "exam", "supplies": "supply", "analysis": "analysi", "payable": "payabl", "referral": "referr", "wages": "wag", "payment": "pay", "training": "train", "electric": "electr", "rental": "rent", "applications": "applicate", "ring": "r", "widget": "widget"}
    assert values(spark, list(cases), X.stem) == list(cases.values())


def test_tokenize(spark):
    got = values(spark, ["Vaccinations Revenue", "Exams / Consultations", "Surgery / Dentistry"], X.tokenize)
    assert [set(x) for x in got] == [{"vaccin"}, {"exam", "consult"}, {"surg", "dent"}]


def test_headers_and_compounds(spark):
    yes = ["Total Revenue", "Gross Profit", "Other Income", "Operating Expenses", "Cost of Goods Sold", "Veterinary Revenue", " revenue "]
    no = ["Veterinary Practice Revenue", "EI Expense", "Interest Revenue", "Total Assets"]
    assert values(spark, yes + no, X.is_section_header) == [True] * len(yes) + [False] * len(no)
    assert values(spark, ["Surgery / Dentistry", "Vaccinations", "A AND B"], X.is_compound) == [True, False, False]


def test_series(spark):
    assert values(spark, ["5050", "9080", "7765"], X.category_of) == ["Revenue", "Other", "Unknown"]


def test_model_text(spark):
    assert values(spark, ['<think>x\n</think>```json\n{"a": 1}\n```', '{"a": 1}', '```{"a": 1}```'], X.model_text) == ['{"a": 1}'] * 3


def test_requested_types(spark):
    from finlattice.plans import workflow

    given = ["all", " Cash_Flow, x,cash_flow", "", None, "income_statement,all", "nothing", ",", "CASH_FLOW"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", workflow.types_of(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [workflow.statement_types(x) for x in given]
