"""Table schemas of the ledger, as DDL text. Flags are INT 0/1, money is DECIMAL(18,2)."""

PARENT_CATEGORIES = "id BIGINT, name STRING, color STRING, icon STRING, is_income INT"

CHILD_CATEGORIES = (
    "id BIGINT, parent_id BIGINT, name STRING, color STRING, icon STRING, is_income INT"
)

ACCOUNTS = (
    "id BIGINT, name STRING, institution STRING, type STRING, account_number STRING, "
    "currency STRING, balance DECIMAL(18,2)"
)

TRANSACTIONS = (
    "id BIGINT, account_id BIGINT, date DATE, description STRING, original_desc STRING, "
    "amount DECIMAL(18,2), child_category_id BIGINT, memo STRING, is_split INT, is_transfer INT, "
    "transfer_to_account_id BIGINT, transfer_investment_cat STRING, currency STRING, tags STRING, "
    "ai_confidence DECIMAL(5,2), hash STRING, notes STRING"
)

SPLITS = (
    "id BIGINT, transaction_id BIGINT, child_category_id BIGINT, amount DECIMAL(18,2), memo STRING"
)

RULES = (
    "id BIGINT, pattern STRING, child_category_id BIGINT, match_type STRING, priority INT, use_count BIGINT"
)

BUDGETS = (
    "id BIGINT, child_category_id BIGINT, month_year DATE, amount DECIMAL(18,2), "
    "carry_forward INT, carry_forward_type STRING"
)

GOALS = (
    "id BIGINT, name STRING, goal_type STRING, target_amount DECIMAL(18,2), "
    "monthly_amount DECIMAL(18,2), target_date DATE, account_id BIGINT"
)
