"""Fixed values that must equal the reference application's for matching results.

Everything in this module is data, stated plainly in natural order. Operators take these
as default parameters; callers can pass their own.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference's published behaviour)
# ---------------------------------------------------------------------------

# Risk band cut points: pd < 0.20 Low, < 0.50 Medium, < 0.75 High, else Critical.
BAND_CUTS = [(0.20, "Low"), (0.50, "Medium"), (0.75, "High")]
BAND_TOP = "Critical"
BANDS = ["Low", "Medium", "High", "Critical"]

HIGH_RISK_PD = 0.5

# Loan grade letters to ordinal.
GRADE_MAP = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}

# Loss given default by loan purpose (consumer variant) and its default.
LGD_CONSUMER = {
    "DEBTCONSOLIDATION": 0.45,
    "EDUCATION": 0.40,
    "HOMEIMPROVEMENT": 0.35,
    "MEDICAL": 0.50,
    "PERSONAL": 0.45,
    "VENTURE": 0.55,
}
LGD_CONSUMER_DEFAULT = 0.45

# Loss given default by sector (small-business variant) and its default.
LGD_MSME = {
    "Retail": 0.35,
    "Manufacturing": 0.45,
    "Construction": 0.55,
    "Technology": 0.30,
    "Agriculture": 0.40,
    "Textile": 0.42,
}
LGD_MSME_DEFAULT = 0.40

# Loss given default for the fixture borrower view (sector = market segment);
# HOUSEHOLD is left out on purpose so the default path is exercised.
LGD_FIXTURE = {"BUILDING": 0.35, "MACHINERY": 0.45, "AUTOMOBILE": 0.30, "FURNITURE": 0.42}
LGD_FIXTURE_DEFAULT = 0.40

# Action escalation ladder, small-business variant: band -> ordered (priority, action, detail).
ACTION_LADDER_MSME = {
    "Low": [
        ("routine", "Continue Standard Monitoring",
         "No immediate action required. Review at next scheduled cycle."),
    ],
    "Medium": [
        ("medium", "Schedule Relationship Manager Call",
         "Discuss business health with borrower within 7 days."),
        ("medium", "Request Updated Financial Statements",
         "Obtain last 3 months bank statements and GST returns."),
    ],
    "High": [
        ("high", "Initiate Document Review",
         "Pull all collateral documents and verify current valuation."),
        ("high", "Cashflow Assessment",
         "Conduct detailed analysis of inflows vs outflows for past 6 months."),
        ("high", "Collateral Verification",
         "Dispatch field officer to verify primary collateral on record."),
    ],
    "Critical": [
        ("critical", "Initiate Restructuring Discussion",
         "Escalate to Senior RM for restructuring evaluation immediately."),
        ("critical", "Evaluate Tenure Extension",
         "Assess feasibility of extending loan tenure to reduce immediate burden."),
        ("critical", "Assign to Recovery Monitoring",
         "Flag in Recovery system and assign dedicated recovery officer."),
        ("critical", "Prepare Legal Documentation",
         "Engage legal team to prepare NPA declaration and recovery notices."),
    ],
}

# Action escalation ladder, consumer variant.
ACTION_LADDER_CONSUMER = {
    "Low": [
        ("routine", "Continue Standard Monitoring",
         "No immediate action required. Review at next scheduled cycle."),
    ],
    "Medium": [
        ("medium", "Schedule Relationship Manager Call",
         "Discuss repayment capacity with borrower within 7 days."),
        ("medium", "Request Updated Income Proof",
         "Obtain recent salary slips / bank statements."),
    ],
    "High": [
        ("high", "Initiate Document Review",
         "Verify income, employment, and collateral documents."),
        ("high", "Affordability Re-assessment",
         "Re-check loan-to-income and obligations vs current income."),
        ("high", "Restrict New Exposure",
         "Hold any top-up / additional credit until reviewed."),
    ],
    "Critical": [
        ("critical", "Initiate Restructuring Discussion",
         "Escalate to Senior RM for restructuring evaluation."),
        ("critical", "Field Investigation",
         "Dispatch officer to verify borrower status."),
        ("critical", "Assign to Recovery Monitoring",
         "Flag in Recovery system and assign recovery officer."),
        ("critical", "Prepare Legal Documentation",
         "Engage legal team for NPA declaration / notices."),
    ],
}

# The sixteen model features of the small-business scorecard, in model order.
MSME_FEATURES = [
    "revolving_utilization", "debt_ratio", "late_30_59", "late_60_89", "late_90_days",
    "open_credit_lines", "real_estate_loans", "num_dependents", "income_stability",
    "gst_compliance_score", "emi_delay_count", "cashflow_stress_ratio",
    "working_capital_usage", "revenue_trend_index", "payment_history_score",
    "supplier_payment_risk",
]

# Scorecard weights (sign and size of each feature's contribution to default risk).
SCORECARD_WEIGHTS = {
    "revolving_utilization": 1.1,
    "debt_ratio": 0.9,
    "late_30_59": 0.6,
    "late_60_89": 0.8,
    "late_90_days": 1.4,
    "open_credit_lines": 0.15,
    "real_estate_loans": -0.25,
    "num_dependents": 0.10,
    "income_stability": -0.7,
    "gst_compliance_score": -0.9,
    "emi_delay_count": 0.7,
    "cashflow_stress_ratio": 0.8,
    "working_capital_usage": 0.6,
    "revenue_trend_index": -0.8,
    "payment_history_score": -1.2,
    "supplier_payment_risk": 0.5,
}
SCORECARD_TARGET_RATE = 0.15
SCORECARD_INTERCEPT_RANGE = (-20.0, 20.0)
ZSCORE_EPS = 1e-9

# Risk-factor groups of the consumer detail view: group -> features.
RISK_FACTOR_GROUPS_CONSUMER = {
    "Repayment & Bureau": ["default_flag", "cb_person_cred_hist_length", "loan_grade_ord"],
    "Affordability / Cashflow": ["loan_percent_income", "loan_int_rate", "loan_amnt"],
    "Borrower Profile": ["person_age", "person_income", "person_emp_length"],
    "Unstructured (Officer Notes)": ["note_stress_index"],
}

# Officer-note stress lexicon (keyword path of the text feature).
LEXICON_NEGATIVE = [
    "pressure", "delay", "delayed", "overdue", "missed", "default", "stress",
    "decline", "declining", "shortfall", "loss", "crisis", "recovery", "npa",
    "deterior", "weak", "concern", "risk", "fail", "drop", "fall", "late",
]
LEXICON_POSITIVE = [
    "normal", "healthy", "strong", "growth", "growing", "stable", "good",
    "profit", "on time", "comfortable", "improv", "robust", "steady",
]
LEXICON_SLOPE = 0.9
EMBEDDING_SCALE = 8.0
NOTE_TONE_CUTS = (0.66, 0.40)  # > 0.66 stressed, > 0.40 neutral, else healthy
MISSING_NOTE_SCORE = 0.5

# Loan status values that count as default in the out-of-domain loan table.
DEFAULT_STATUSES = ["charged off", "default", "late (31-120 days)", "late (16-30 days)"]

# Threshold grid for the operating-point sweep: linspace(0.05, 0.95, 91).
SWEEP_START, SWEEP_STOP, SWEEP_STEPS = 0.05, 0.95, 91
INCOME_SCALE = 100_000.0  # monthly income of full stability (fixed value)
RECALL_FLOOR = 0.85
RECALL_FLOOR_FALLBACK = 0.30
OPERATING_POINTS = [0.30, 0.50, 0.63]

# Scenario months and multipliers (small-business trajectory), s = i / 11.
SCENARIO_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Question routing words (template answerer); matching is by substring.
ROUTE_ACTION_WORDS = ["action", "do", "recommend"]
ROUTE_TREND_WORDS = ["changed", "trend", "month", "six"]

# Default values used when an upload lacks a column (small-business variant).
UPLOAD_DEFAULTS_MSME = {
    "sector": "Retail",
    "loan_type": "Term Loan",
    "outstanding_loan": 1_000_000.0,
}

# Upload batch bounds for a refresh.

# Fixture lexicon used by oracle queries over the invented-prose documents table.
FIXTURE_LEXICON_NEGATIVE = ["ere", "sch", "ando"]
FIXTURE_LEXICON_POSITIVE = ["tion", "elle", "lesh"]

# Fixture scorecard intercept (literal in both engines).
FIXTURE_INTERCEPT = -2.0

# Driver narratives, small-business variant: feature -> (template, tiers, else-word).
# Placeholders: {pct} = value x 100 with 0 decimals, {v2} = value with 2 decimals,
# {int} = value truncated to an integer, {tier} = first tier whose rule holds.
# Tier rules are (">", bound) or ("==", bound) tested in order.
NARRATIVES_MSME = {
    "revolving_utilization": ("Working capital line utilized at {pct}% — {tier}.",
                              [(">", 0.7, "dangerously high"), (">", 0.4, "elevated")], "healthy"),
    "debt_ratio": ("Debt-to-income ratio is {v2} — {tier}.", [(">", 1.0, "critical"), (">", 0.5, "high")], "manageable"),
    "late_30_59": ("Borrower had {int} payment(s) 30-59 days late in the observation window.", [], None),
    "late_60_89": ("Borrower had {int} payment(s) 60-89 days overdue — significant stress indicator.", [], None),
    "late_90_days": ("Borrower had {int} serious delinquency event(s) (90+ days late) — NPA risk.", [], None),
    "open_credit_lines": ("Borrower holds {int} open credit lines — {tier}.", [(">", 15, "over-leveraged")], "normal"),
    "real_estate_loans": ("Borrower has {int} real estate loan(s) as collateral exposure.", [], None),
    "num_dependents": ("Borrower supports {int} dependent(s) — impacts disposable income.", [], None),
    "income_stability": ("Income stability index: {v2} — {tier}.", [(">", 0.6, "strong"), (">", 0.3, "moderate")], "weak"),
    "gst_compliance_score": ("GST compliance score: {v2}/1.0 — {tier}.",
                             [(">", 0.8, "regular filer"), (">", 0.5, "irregular filings detected")],
                             "non-compliant, high risk"),
    "emi_delay_count": ("EMI delays recorded: {int} — {tier}.", [("==", 0, "no delays")], "payment stress visible"),
    "cashflow_stress_ratio": ("Cashflow stress index: {v2} — {tier}.", [(">", 2.0, "severe"), (">", 1.0, "moderate")], "low"),
    "working_capital_usage": ("Working capital drawn: {pct}% of sanctioned limit.", [], None),
    "revenue_trend_index": ("Revenue trend index: {v2} — {tier}.", [(">", 1.1, "growing"), (">", 0.9, "stable")], "declining"),
    "payment_history_score": ("Payment history score: {v2}/1.0 — {tier}.",
                              [(">", 0.9, "excellent"), (">", 0.7, "fair")], "poor track record"),
    "supplier_payment_risk": ("Supplier payment risk flag: {tier}.",
                              [(">", 0, "Active — delays to creditors detected")], "Clear — no creditor delays"),
    "note_stress_index": ("Officer-notes stress index (NLP): {v2}/1.0 — {tier}.",
                          [(">", 0.66, "alarming language in notes"), (">", 0.4, "some concern in notes")],
                          "notes read healthy"),
}

# Driver narratives, consumer variant (further placeholders: {v0}, {v1} = value with 0 and 1 decimals, {money} = whole
# units with thousands separators, {grade} = letter of the rounded ordinal).
NARRATIVES_CONSUMER = {
    "note_stress_index": ("Officer-notes stress index (NLP): {v2}/1.0 — {tier}.",
                          [(">", 0.66, "alarming language in notes"), (">", 0.4, "some concern in notes")],
                          "notes read healthy"),
    "person_age": ("Borrower age: {v0} years.", [], None),
    "person_income": ("Annual income: ${money} — {tier}.", [("<", 40000, "low"), ("<", 90000, "moderate")], "high"),
    "person_emp_length": ("Employment length: {v0} year(s) — {tier}.", [("<", 2, "short tenure")], "stable"),
    "loan_amnt": ("Loan amount: ${money}.", [], None),
    "loan_int_rate": ("Interest rate: {v1}% — {tier}.", [(">", 15, "high (subprime)"), (">", 11, "elevated")], "prime"),
    "loan_percent_income": ("Loan is {pct}% of income — {tier}.",
                            [(">", 0.4, "very high burden"), (">", 0.25, "high")], "manageable"),
    "cb_person_cred_hist_length": ("Credit history: {v0} year(s) — {tier}.", [("<", 3, "thin file")], "established"),
    "loan_grade_ord": ("Loan grade: {grade} ({v0}/7) — {tier}.", [(">=", 4, "subprime")], "prime"),
    "default_flag": ("{tier}", [(">", 0.5, "Prior default on file — major red flag.")], "No prior default on file."),
}
# One-hot levels of a driver: sentence when the level is the applicant's, none otherwise.
LEVEL_NARRATIVES_CONSUMER = {"person_home_ownership": "Home ownership: {level}.", "loan_intent": "Loan purpose: {level}."}

# Sentences of the risk-factor breakdown, consumer variant.
NARRATIVES_FACTORS = {
    "note_stress_index": ("Officer-notes stress index (NLP): {v2}/1.0 — {tier}.",
                          [(">", 0.66, "alarming language"), (">", 0.4, "some concern")], "notes read healthy"),
    "person_age": ("Borrower age: {int} years.", [], None),
    "person_income": ("Annual income: ${money} — {tier}.", [("<", 40000, "low"), ("<", 90000, "moderate")], "high"),
    "person_emp_length": ("Employment length: {v0} year(s) — {tier}.", [("<", 2, "short tenure")], "stable"),
    "loan_amnt": ("Loan amount: ${money}.", [], None),
    "loan_int_rate": ("Interest rate: {v1}% — {tier}.", [(">", 15, "subprime"), (">", 11, "elevated")], "prime"),
    "loan_percent_income": ("Loan is {pct}% of income — {tier}.",
                            [(">", 0.4, "very high burden"), (">", 0.25, "high")], "manageable"),
    "cb_person_cred_hist_length": ("Credit history: {int} year(s).", [], None),
    "loan_grade_ord": ("Loan grade {grade} ({int}/7).", [], None),
    "default_flag": ("{tier}", [(">", 0.5, "Prior default on file.")], "No prior default."),
}
# Exposure of a consumer loan in the report's currency, per unit of the loan amount.
CONSUMER_EXPOSURE_SCALE = 100

DRIVERS_EXPLAIN, DRIVERS_CONTEXT, DRIVERS_ANSWER = 8, 5, 3
ATTENTION_TOP = 5
