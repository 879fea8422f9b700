"""Default category tree and default budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Colour and icon of the default parents.
PARENT_LOOKS = {
    "Income": ("#22c55e", "💵"), "Housing": ("#3b82f6", "🏠"), "Utilities": ("#0ea5e9", "💡"),
    "Food & Dining": ("#f59e0b", "🍽️"), "Transportation": ("#8b5cf6", "🚗"), "Health & Medical": ("#ef4444", "🏥"),
    "Personal Care": ("#a78bfa", "🧴"), "Shopping": ("#ec4899", "🛍️"), "Entertainment": ("#06b6d4", "🎬"),
    "Travel": ("#14b8a6", "✈️"), "Education": ("#fbbf24", "📚"), "Children & Family": ("#fb923c", "👶"),
    "Pets": ("#84cc16", "🐾"), "Gifts & Donations": ("#f87171", "🎁"), "Subscriptions": ("#7c3aed", "📱"),
    "Cell Phone": ("#0284c7", "📱"), "Financial": ("#64748b", "💳"), "Investments": ("#10b981", "📈"),
    "Taxes": ("#dc2626", "🏛️"), "Business Expenses": ("#78716c", "🏢"), "Uncategorized": ("#6b7280", "❓"),
}

# Default category tree, parent -> children.
CATEGORY_TREE = {
    "Income": [
        "Salary & Wages", "Employment Income", "Bonus & Commission", "Freelance", "Dividends",
        "Interest Income", "Capital Gains", "Rental Income", "CPP / OAS", "EI Benefits",
        "Child Benefits (CCB)", "Tax Refund", "Other Income", "Personal Income",
    ],
    "Housing": [
        "Mortgage", "Rent", "Property Tax", "Home Insurance", "Condo Fees / HOA", "Home Maintenance",
        "Furniture & Decor",
    ],
    "Utilities": ["Electricity", "Natural Gas / Heat", "Water & Sewer", "Internet", "Cable / Satellite TV"],
    "Food & Dining": [
        "Groceries", "Restaurants", "Fast Food", "Coffee & Cafes", "Alcohol & LCBO", "Food Delivery",
        "Dining & Drinks",
    ],
    "Transportation": [
        "Gas & Fuel", "Car Insurance", "Car Payment", "Car Maintenance", "Parking", "Tolls & 407",
        "Public Transit", "Taxi & Rideshare", "Auto & Transport", "Car Wash", "Service & Parts",
    ],
    "Health & Medical": [
        "Doctor & Specialists", "Dentist", "Optometrist & Vision", "Pharmacy", "Mental Health",
        "Physiotherapy", "Health Insurance", "Gym & Fitness",
    ],
    "Personal Care": ["Hair & Salon", "Spa & Massage", "Cosmetics & Beauty", "Clothing & Apparel"],
    "Shopping": [
        "Amazon", "Electronics & Tech", "Home Goods", "Department Stores", "Online Shopping",
        "Warehouse Clubs", "Shopping",
    ],
    "Entertainment": [
        "Streaming Services", "Movies & Cinema", "Concerts & Events", "Books & Magazines",
        "Hobbies & Crafts", "Gaming", "Entertainment",
    ],
    "Travel": ["Flights", "Hotels & Accommodation", "Travel Insurance", "Car Rental"],
    "Education": ["Tuition & Fees", "Textbooks & Supplies", "Online Courses", "Student Loans", "Education"],
    "Children & Family": ["Childcare & Daycare", "Baby Supplies", "Kids Activities", "Toys & Games", "Kids"],
    "Pets": ["Pet Food", "Vet & Medical", "Pet Insurance", "Pet Grooming"],
    "Gifts & Donations": ["Gifts Given", "Charitable Donations", "Religious Donations", "Charity & Donations"],
    "Subscriptions": [
        "Streaming Video", "Streaming Music", "Software & SaaS", "News & Magazines", "Gaming Subscriptions",
    ],
    "Cell Phone": ["Monthly Plan", "Device Payments"],
    "Financial": [
        "Credit Card Payment", "Bank Fees", "Interest Charges", "Transfer", "Personal Loan",
        "Line of Credit", "Fees & Charges", "Balance Adjustment", "Cash & ATM",
    ],
    "Investments": [
        "RRSP", "TFSA", "RESP", "Stocks", "ETFs", "Bonds", "Crypto", "GICs & Term Deposits",
        "Pension Contributions", "Robo-Advisor",
    ],
    "Taxes": ["Federal Income Tax", "Provincial Tax", "Tax Preparation", "HST / GST Remittance", "Taxes"],
    "Business Expenses": [
        "Office Supplies", "Business Travel", "Client Entertainment", "Accounting & Legal",
        "Business Insurance",
    ],
    "Uncategorized": ["Uncategorized", "Uncategorized Item"],
}

# Colour and icon of each default child, in the order of the tree.
CHILD_LOOKS = {
    "Income": [
        ("#15803d", "💰"), ("#1a9850", "💼"), ("#14532d", "🏆"), ("#22c55e", "💻"), ("#4ade80", "💹"), ("#16a34a", "🏦"), ("#15803d", "📊"),
        ("#166534", "🏠"), ("#34d399", "🇨🇦"), ("#10b981", "🤝"), ("#059669", "👶"), ("#047857", "📋"), ("#6b7280", "💰"), ("#22c55e", "💵"),
    ],
    "Housing": [
        ("#2563eb", "🏦"), ("#60a5fa", "🔑"), ("#3b82f6", "🏛️"), ("#2563eb", "🛡️"), ("#1d4ed8", "🏢"), ("#1e40af", "🔧"), ("#bfdbfe", "🛋️"),
    ],
    "Utilities": [
        ("#0284c7", "⚡"), ("#0369a1", "🔥"), ("#075985", "💧"), ("#0c4a6e", "🌐"), ("#082f49", "📡"),
    ],
    "Food & Dining": [
        ("#d97706", "🛒"), ("#b45309", "🍴"), ("#92400e", "🍔"), ("#78350f", "☕"), ("#c2410c", "🍷"), ("#f97316", "🛵"), ("#b45309", "🍽️"),
    ],
    "Transportation": [
        ("#7c3aed", "⛽"), ("#6d28d9", "🛡️"), ("#5b21b6", "🚘"), ("#4c1d95", "🔩"), ("#a855f7", "🅿️"), ("#c084fc", "🛣️"), ("#d8b4fe", "🚌"),
        ("#e9d5ff", "🚕"), ("#7c3aed", "🚗"), ("#9333ea", "🚿"), ("#6d28d9", "🔧"),
    ],
    "Health & Medical": [
        ("#dc2626", "👨‍⚕️"), ("#b91c1c", "🦷"), ("#991b1b", "👓"), ("#7f1d1d", "💊"), ("#fca5a5", "🧠"), ("#f87171", "🦴"), ("#b91c1c", "🛡️"),
        ("#991b1b", "🏋️"),
    ],
    "Personal Care": [
        ("#8b5cf6", "💇"), ("#7c3aed", "💆"), ("#6d28d9", "💄"), ("#5b21b6", "👕"),
    ],
    "Shopping": [
        ("#db2777", "📦"), ("#be185d", "📱"), ("#f9a8d4", "🏡"), ("#f472b6", "🏬"), ("#ec4899", "🖥️"), ("#db2777", "🏪"), ("#ec4899", "🛍️"),
    ],
    "Entertainment": [
        ("#0891b2", "📺"), ("#0e7490", "🎥"), ("#155e75", "🎤"), ("#67e8f9", "📚"), ("#22d3ee", "🎯"), ("#06b6d4", "🎮"), ("#06b6d4", "🎬"),
    ],
    "Travel": [
        ("#0f766e", "🛫"), ("#0d9488", "🏨"), ("#115e59", "🛡️"), ("#134e4a", "🚙"),
    ],
    "Education": [
        ("#f59e0b", "🎓"), ("#b45309", "📝"), ("#92400e", "💻"), ("#78350f", "📖"), ("#f59e0b", "📚"),
    ],
    "Children & Family": [
        ("#f97316", "🧒"), ("#ea580c", "🍼"), ("#c2410c", "⚽"), ("#9a3412", "🧸"), ("#fb923c", "👧"),
    ],
    "Pets": [
        ("#65a30d", "🦴"), ("#4d7c0f", "🐶"), ("#3f6212", "🛡️"), ("#365314", "✂️"),
    ],
    "Gifts & Donations": [
        ("#ef4444", "🎀"), ("#dc2626", "❤️"), ("#b91c1c", "⛪"), ("#ef4444", "🎁"),
    ],
    "Subscriptions": [
        ("#6d28d9", "📺"), ("#5b21b6", "🎵"), ("#4c1d95", "💻"), ("#3b0764", "📰"), ("#7c3aed", "🎮"),
    ],
    "Cell Phone": [
        ("#0369a1", "📡"), ("#075985", "📱"),
    ],
    "Financial": [
        ("#475569", "💳"), ("#334155", "🏦"), ("#1e293b", "📊"), ("#94a3b8", "↔️"), ("#64748b", "💰"), ("#94a3b8", "📄"), ("#475569", "💸"),
        ("#64748b", "⚖️"), ("#94a3b8", "💵"),
    ],
    "Investments": [
        ("#059669", "🏦"), ("#047857", "💹"), ("#065f46", "🎓"), ("#22c55e", "📈"), ("#16a34a", "💹"), ("#15803d", "📉"), ("#166534", "₿"),
        ("#14532d", "🔒"), ("#166534", "🏦"), ("#16a34a", "🤖"),
    ],
    "Taxes": [
        ("#b91c1c", "🇨🇦"), ("#991b1b", "🏛️"), ("#ef4444", "📋"), ("#dc2626", "💰"), ("#dc2626", "🏛️"),
    ],
    "Business Expenses": [
        ("#57534e", "🖊️"), ("#44403c", "✈️"), ("#292524", "🍽️"), ("#57534e", "⚖️"), ("#78716c", "🛡️"),
    ],
    "Uncategorized": [
        ("#6b7280", "❓"), ("#6b7280", "❓"),
    ],
}
INCOME_PARENTS = ["Income"]

# Default monthly budgets, parent -> child -> amount.
DEFAULT_BUDGETS = {
    "Housing": {"Mortgage": 1800, "Property Tax": 200, "Home Insurance": 150, "Home Maintenance": 100},
    "Utilities": {"Electricity": 100, "Natural Gas / Heat": 80, "Water & Sewer": 50, "Internet": 80},
    "Food & Dining": {
        "Groceries": 600, "Restaurants": 150, "Fast Food": 80, "Coffee & Cafes": 60, "Food Delivery": 50,
        "Alcohol & LCBO": 50, "Dining & Drinks": 150,
    },
    "Transportation": {
        "Gas & Fuel": 150, "Car Insurance": 200, "Car Payment": 400, "Car Maintenance": 75,
        "Public Transit": 100, "Parking": 40, "Taxi & Rideshare": 30,
    },
    "Health & Medical": {
        "Doctor & Specialists": 50, "Dentist": 50, "Pharmacy": 40, "Health Insurance": 100, "Gym & Fitness": 50,
    },
    "Personal Care": {"Hair & Salon": 60, "Cosmetics & Beauty": 30},
    "Shopping": {"Amazon": 100, "Online Shopping": 75, "Electronics & Tech": 50, "Shopping": 150},
    "Entertainment": {"Movies & Cinema": 60, "Concerts & Events": 75, "Hobbies & Crafts": 30, "Entertainment": 100},
    "Cell Phone": {"Monthly Plan": 60},
    "Subscriptions": {"Streaming Video": 25, "Streaming Music": 12, "Software & SaaS": 20},
    "Financial": {"Bank Fees": 20},
    "Investments": {"RRSP": 500, "TFSA": 300, "RESP": 200},
    "Gifts & Donations": {"Gifts Given": 50, "Charitable Donations": 50},
    "Children & Family": {"Childcare & Daycare": 800, "Kids Activities": 100, "Kids": 50},
}
DEFAULT_BUDGET_DATE = "2024-01-01"


def default_parents(spark: SparkSession) -> DataFrame:
    rows = [(name, int(name in INCOME_PARENTS), *PARENT_LOOKS[name]) for name in CATEGORY_TREE]
    return spark.createDataFrame(rows, "name STRING, is_income INT, color STRING, icon STRING")


def default_children(spark: SparkSession) -> DataFrame:
    rows = [
        (parent, child, int(parent in INCOME_PARENTS), *look)
        for parent, names in CATEGORY_TREE.items()
        for child, look in zip(names, CHILD_LOOKS[parent], strict=True)
    ]
    return spark.createDataFrame(rows, "parent STRING, name STRING, is_income INT, color STRING, icon STRING")


def default_budgets(spark: SparkSession) -> DataFrame:
    rows = [(parent, child, amount) for parent, lines in DEFAULT_BUDGETS.items() for child, amount in lines.items()]
    return spark.createDataFrame(rows, "parent STRING, child STRING, amount INT").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)")
    )
