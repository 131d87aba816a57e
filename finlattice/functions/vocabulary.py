"""Word lists, patterns and tables that results depend on."""

FILLERS = """revenue expense expenses cost costs sales service services fees total other general administrative the and of for from with on in to
program programmes payments adjustments discounts returns allowances write-off adjustment subsidy expansion salary rebate""".split()
COMPOUND_SEPARATORS = ["/", " & ", " and ", " + "]
HEADER_PATTERNS = [
    r"^total\s+(revenue|expenses?|income|cost|sales)$",
    r"^(revenue|expenses?|income|cost|sales)\s+total$",
    r"^other\s+(revenue|expenses?|income)$",
    r"^(gross|net)\s+(profit|income|loss|revenue|margin)$",
    r"^operating\s+(expenses?|income|profit|revenue)$",
    r"^cost\s+of\s+(goods\s+sold|revenue|sales)$",
    r"^(revenue|expenses?|income)$",
    r"^(veterinary|practice)\s+(revenue|income|sales)$",
]
STEM_RULES = [
    ("ations?$", "ate"), ("ication$", "icate"), ("ings?$", ""), ("ies?$", "y"), ("es?$", ""), ("s$", ""), ("ment$", ""), ("able$", ""), ("ible$", ""), ("tion$", ""), ("sis$", "s"), ("al$", ""), ("ic$", ""),
]
STEMS = {
    "vaccinations": "vaccin", "vaccine": "vaccin", "vaccin": "vaccin", "diagnostics": "diagnost", "diagnostic": "diagnost", "diagnose": "diagnost",
    "boarding": "board", "board": "board", "cremation": "cremat", "cremations": "cremat", "mortuary": "mortuar", "homeopathy": "homeopath",
    "homeopathic": "homeopath", "alternative": "altern", "complementary": "complement", "medicine": "medicin", "medicines": "medicin",
    "medical": "medic", "surgery": "surg", "surgical": "surg", "dentistry": "dent", "dental": "dent", "exams": "exam", "exam": "exam",
    "examination": "exam", "consultations": "consult", "consultation": "consult", "consult": "consult", "food": "food", "foods": "food",
    "dietary": "diet", "diet": "diet", "diets": "diet", "drug": "drug", "drugs": "drug", "pharmacy": "pharm", "pharmaceutical": "pharm",
    "pharmacist": "pharm", "sales": "sale", "sale": "sale", "revenue": "revenu", "revenues": "revenu", "expense": "expens", "expenses": "expens",
    "cost": "cost", "costs": "cost", "cpp": "cpp", "ei": "ei", "whscc": "whscc", "payroll": "payroll", "tax": "tax", "taxes": "tax",
    "accounting": "account", "account": "account", "legal": "leg", "law": "law", "attorney": "attorney",
}
CATEGORIES = {"1000": "Asset", "2000": "Asset", "3000": "Liability", "4000": "Equity", "5000": "Revenue", "6000": "Direct Cost", "7000": "Operating Expense", "8000": "Other Expense", "9000": "Other"}
METRIC_ALIASES = {
    "revenue": ["revenue", "total revenue", "net revenue", "net sales", "sales", "turnover"],
    "gross_profit": ["gross profit", "gross margin"],
    "operating_income": ["operating income", "operating profit", "income from operations", "operating earnings"],
    "net_income": ["net income", "net profit", "net earnings", "profit for the year", "profit for the period"],
    "ebitda": ["ebitda", "adjusted ebitda"],
    "total_assets": ["total assets", "assets"],
    "total_liabilities": ["total liabilities", "liabilities", "total debt and equity"],
    "total_equity": ["total equity", "shareholders' equity", "stockholders' equity", "equity", "net assets"],
    "cash_and_equivalents": ["cash and equivalents", "cash", "cash and cash equivalents", "cash & equivalents"],
    "total_debt": ["total debt", "debt", "borrowings", "total borrowings"],
    "operating_cash_flow": ["operating cash flow", "cash from operations", "net cash from operating"],
    "free_cash_flow": ["free cash flow", "fcf", "free cash"],
}
SECTION_WORDS = {
    "5": ["REVENUE", "INCOME", "SALES", "FEES EARNED", "TURNOVER"],
    "6": ["COST OF", "COGS", "DIRECT COST"],
    "7": ["EXPENSE", "OPERATING", "G&A", "GENERAL", "ADMINISTRATIVE", "SELLING", "DISTRIBUTION", "OVERHEAD", "PAYROLL"],
}
ALIAS_FILLERS = "revenue expense expenses cost costs services service sales fees total other and the a an".split()
#: Our own words over the blocks of a chart in a prompt.
CHART_HEADINGS = {
    "5": "Revenue (accounts 5000 to 5999)",
    "6": "Direct costs (accounts 6000 to 6999)",
    "7": "Operating expenses (accounts 7000 to 7999)",
    "8": "Depreciation and other expenses (accounts 8000 to 8999)",
    "9": "Interest, taxes and other items (accounts 9000 to 9999)",
}
REQUIRED_SECTIONS = {
    "balance_sheet": ["ASSET", "LIABILIT", "EQUITY"],
    "income_statement": ["REVENUE", "EXPENSE", "NET INCOME"],
    "cash_flow": ["OPERATING", "INVESTING", "FINANCING"],
}
BALANCE_METRICS = ["total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "total_debt"]
CASH_METRICS = ["operating_cash_flow", "free_cash_flow"]
REVIEW_COLUMNS = ["CoA Code", "CoA Name", "CoA Category", "Match Type", "Confidence", "Reasoning", "Needs Review", "Citation"]
