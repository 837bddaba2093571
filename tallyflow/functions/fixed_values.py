"""Fixed values. Results depend on these exact words, numbers and patterns; they are data, not design."""

# ---- fixed values: category rules --------------------------------------------------------------------
# type | category | keywords | words that must be absent. First matching line wins.
CATEGORY_RULES = """
income | Salary | salary, payroll, wage, pay
income | Freelance | freelance, consulting, contract, gig
income | Investment | dividend, interest, investment, stock
income | Bonus | bonus, commission, tip
income | Refund | refund, reimbursement
expense | Housing | rent, mortgage, property, lease
expense | Utilities | electric, electricity, pg&e, pge, power, water, gas bill, utility
expense | Utilities | internet, comcast, xfinity, wifi, broadband
expense | Utilities | phone, mobile, verizon, at&t, tmobile, t-mobile, cellular
expense | Transportation | gas, fuel, shell, chevron, 76, exxon, mobil, bp, arco, petrol
expense | Transportation | uber, lyft, taxi, cab, ride
expense | Transportation | parking, toll, metro, transit, bus, train
expense | Transportation | car insurance, auto insurance, geico, progressive, state farm
expense | Transportation | car wash, oil change, mechanic, repair, maintenance, tire
expense | Groceries | grocery, groceries, supermarket, safeway, whole foods, trader joe, costco, walmart, target
expense | Dining | restaurant, cafe, coffee, starbucks, dunkin, mcdonald, burger, pizza, chipotle, subway, taco, dining, food, lunch, dinner, breakfast
expense | Entertainment | netflix, hulu, disney, spotify, apple music, youtube premium, amazon prime, subscription, streaming
expense | Entertainment | gym, fitness, yoga, la fitness, planet fitness, workout
expense | Entertainment | movie, cinema, theater, amc, concert, show, ticket
expense | Entertainment | game, gaming, steam, playstation, xbox, nintendo
expense | Shopping | amazon, ebay, etsy, shopping, purchase
expense | Shopping | clothing, clothes, fashion, nordstrom, macy, gap, zara, h&m
expense | Shopping | electronics, best buy, apple store, computer, phone
expense | Shopping | home depot, lowes, hardware, furniture, ikea
expense | Healthcare | health insurance, medical, doctor, hospital, clinic, pharmacy, cvs, walgreens, prescription, medicine
expense | Healthcare | dental, dentist, orthodont
expense | Pet Care | vet, veterinary, animal hospital, pet clinic
expense | Personal Care | haircut, salon, barber, spa, beauty, cosmetic
expense | Education | school, tuition, education, course, udemy, coursera, book, textbook
expense | Gifts | gift, present, donation, charity
expense | Insurance | insurance | auto, car
"""
DEFAULT_INCOME_CATEGORY = "Other Income"
DEFAULT_EXPENSE_CATEGORY = "Other"
MISSING_CATEGORY = "uncategorized"

# ---- fixed values: words that make a zero amount an income -------------------------------------------
ZERO_AMOUNT_INCOME_WORDS = """
salary, payroll, deposit, wage, freelance, consulting, dividend, interest, bonus, refund, reimbursement,
tax refund, payment from, cashback, reward, rebate
"""
INCOME_TYPE_WORDS = ("income", "credit")

# ---- fixed values: category sets ---------------------------------------------------------------------
DEBT_CATEGORIES = ("debt", "loan", "credit card")
INVESTMENT_CATEGORIES = ("investment", "stocks", "retirement")
BUDGET_TIP_CATEGORIES = ("shopping", "entertainment", "dining")
IRREGULAR_EMPLOYMENT = ("gig", "informal")

# ---- fixed values: agents ----------------------------------------------------------------------------
AGENT_TYPES = ("financial", "research", "productivity", "learning")
DEFAULT_AGENT = "financial"

# ---- fixed values: investment strategies (risk tolerance, bonds, stocks, cash, expected return, funds) ---
INVESTMENT_STRATEGIES = (
    ("conservative", 60, 30, 10, "4-6% annually", "Index funds, Government bonds, High-yield savings"),
    ("moderate", 40, 50, 10, "6-8% annually", "Balanced index funds, ETFs, Some growth stocks"),
    ("aggressive", 20, 70, 10, "8-12% annually", "Growth stocks, Tech ETFs, Emerging markets"),
)
DEFAULT_RISK_TOLERANCE = "moderate"

# ---- fixed values: mitigation (risk type, strategy, timeline, priority) ------------------------------
MITIGATIONS = (
    ("income_volatility", "Build emergency fund covering 6-12 months of expenses", "6-12 months", "high"),
    ("overspending", "Create and follow a strict budget, reduce non-essential expenses", "1-3 months", "high"),
    ("emergency_fund", "Automate savings to build emergency fund gradually", "12-18 months", "medium"),
)

# ---- fixed values: rule-based recommendations (category, priority, action, impact, timeline) ---------
SAVINGS_RECOMMENDATION = (
    "savings", "high", "Increase savings rate to at least 10% of income",
    "Build financial security and emergency fund", "1-3 months",
)
EMERGENCY_RECOMMENDATION = (
    "emergency_fund", "high", "Build emergency fund covering 6-12 months of expenses",
    "Protect against income volatility", "6-12 months",
)

# ---- fixed values: advice text -----------------------------------------------------------------------
ADVICE_PATTERN = r"(?:recommendation|advice|suggestion)[:\s]*([^.!?]*[.!?])"
ADVICE_FIELDS = ("general", "medium", "positive", "immediate")
NON_LIST_ADVICE = (
    "Focus on increasing your savings rate",
    "Review and reduce unnecessary expenses",
    "Build an emergency fund",
)
FAILED_ADVICE = (
    "Track your spending to identify areas for improvement",
    "Aim to save at least 20% of your income",
    "Build an emergency fund covering 3-6 months of expenses",
)
