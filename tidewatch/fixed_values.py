"""Lists, limits and sentences that results must carry unchanged."""

# --- accepted values -------------------------------------------------------
PRIORITIES = ["low", "medium", "high", "critical"]
STATUSES = ["open", "in_progress", "resolved", "closed"]
STATUSES_VALIDATED = ["open", "in_progress", "resolved", "closed", "escalated"]
MARKET_CATEGORIES = ["competitor", "market", "regulatory", "hiring", "technology", "sentiment"]
SEVERITIES = ["critical", "high", "medium", "low"]
ROLE_LEVELS = ["analyst", "lead", "executive"]
FEED_TYPES = ["workforce", "tickets", "market"]
FEED_EXTENSIONS = [".csv", ".json"]

# --- service targets by priority -------------------------------------------
SLA_HOURS = {"critical": 4, "high": 8, "medium": 24, "low": 72}
SLA_MINUTES = {"critical": 240, "high": 480, "medium": 1440, "low": 4320}

# --- required and numeric columns of the feeds -------------------------------
WORKFORCE_REQUIRED = ["employee_id", "date", "scheduled_hours", "actual_hours"]
WORKFORCE_NUMERIC = [
    "scheduled_hours", "actual_hours", "overtime_hours", "tasks_completed",
    "tasks_assigned", "demand_units", "capacity_units",
]
TICKET_REQUIRED = ["ticket_id", "created_at", "category", "priority", "status"]

# --- rule sets of the row validator ------------------------------------------
RULES = {
    "employee": {
        "required": ["employee_code", "full_name", "email", "role", "department_code", "hire_date"],
        "email": ["email"],
        "date": ["hire_date"],
        "non_negative": ["hourly_rate"],
    },
    "operations": {
        "required": ["employee_code", "date", "scheduled_hours", "actual_hours"],
        "date": ["date"],
        "non_negative": ["scheduled_hours", "actual_hours", "overtime_hours"],
        "range": {"scheduled_hours": (0, 24), "actual_hours": (0, 24)},
    },
    "ticket": {
        "required": ["ticket_number", "created_at", "category", "priority", "status"],
        "date": ["created_at", "resolved_at"],
        "enum": {"priority": PRIORITIES, "status": STATUSES_VALIDATED},
    },
    "market_signal": {
        "required": ["signal_date", "category", "source", "title"],
        "date": ["signal_date"],
        "range": {"sentiment_score": (-1.0, 1.0), "relevance_score": (0.0, 1.0)},
        "enum": {"category": MARKET_CATEGORIES},
    },
}
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# --- text that a CSV reader takes for a missing value ------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- defaults of new dimension members ---------------------------------------
DEFAULT_DEPARTMENT = "UNKNOWN"
DEFAULT_LOCATION = "HQ"
LOCATION_COUNTRY = "Canada"
LOCATION_TIMEZONE = "America/Toronto"
EMPLOYEE_DEFAULTS = {
    "first_name": "Unknown",
    "last_name": "Employee",
    "role": "Staff",
    "level": "mid",
    "employment_type": "full-time",
}
EMPLOYEE_EMAIL_DOMAIN = "@company.com"

# --- likely causes of a flagged value: metric -> (spike, drop) ----------------
# %s is the magnitude, "Significant" above |z| 3.5 and "Notable" otherwise.
CAUSES = {
    "ticket_volume": (
        "%s increase in support demand — check for product issues or outages",
        "%s drop in ticket volume — possible reporting gap or holiday",
    ),
    "absent": (
        "%s absenteeism spike — possible illness outbreak or scheduling conflict",
        "Unusually low absences — data completeness check recommended",
    ),
    "utilization_rate": (
        "Over-utilization detected — risk of burnout and quality degradation",
        "%s under-utilization — demand mismatch or scheduling gap",
    ),
    "demand_units": (
        "%s demand surge — verify staffing coverage",
        "%s demand drop — seasonal or external factor likely",
    ),
}
CAUSE_DEFAULT = ("%s upward deviation in ", "%s downward deviation in ")

# --- reasons given for a multivariate anomaly ---------------------------------
REASON_TICKETS_HIGH = "Unusually high ticket volume — possible system incident or product release"
REASON_TICKETS_CRITICAL = "Critical tickets present: %d"
REASON_TICKETS_BREACHES = "Elevated SLA breach rate — may indicate staffing shortage"
REASON_WORKFORCE_LOW = "Unusually low utilization — possible mass absence or public holiday"
REASON_WORKFORCE_ABSENT = "High absence: %d employees absent"
REASON_WORKFORCE_OVERTIME = "High overtime — demand likely exceeding capacity"
REASON_OTHER = "Value %s historical norm by %s standard deviations"

# --- forecast sentences -------------------------------------------------------
METHOD_RIDGE = "ridge_regression"
METHOD_HOLT_WINTERS = "Holt-Winters Exponential Smoothing"
METHOD_LINEAR = "Linear Trend Regression"
METHOD_NAIVE = "Naive Mean Forecast"
FORECAST_SUMMARY = (
    "%s is forecast to %s by %s%% over the next %d days (from avg %s to %s). Trend direction: %s."
)
FORECAST_SUMMARY_NAIVE = (
    "Insufficient history for trend analysis. Forecasting flat at mean of %s."
)

# --- period narrative ---------------------------------------------------------
FINDING_UTILIZATION = (
    "Workforce utilization averaged %s%% over the period (%d active employees tracked)."
)
FINDING_DEMAND_DOWN = "Support demand decreased %s%% period-over-period."
FINDING_COMPLIANCE = "SLA compliance at %s%%."
FINDING_CAPACITY = "Utilization at %s%% suggests available capacity — review scheduling efficiency."
FINDING_OVERTIME = "Overtime hours totalled %sh — monitor for burnout signals."
ALERT_DEMAND = "Support demand rose %s%% period-over-period (%d tickets vs %d prior)."
ALERT_BREACH = "SLA breach rate reached %s%% — exceeds the 20%% warning threshold."
ALERT_UTILIZATION = "Workforce is operating at %s%% utilization — over-capacity risk."
ALERT_COVERAGE = "Demand (%s%% of capacity) is outpacing available staff headcount."
ADVICE_DEMAND = "Review staffing allocation to handle elevated support volume."
ADVICE_BREACH = "Audit high-priority ticket queues and escalation paths."
ADVICE_UTILIZATION = "Consider temporary staffing augmentation or workload redistribution."
HEADLINE_SURGE = "High demand surge with SLA risk — immediate attention recommended"
HEADLINE_BREACH = "SLA performance below target — review ticket resolution capacity"
HEADLINE_DEMAND = "Support volume trending up significantly — staffing alignment needed"
HEADLINE_OVER = "Workforce at near-maximum capacity — monitor for quality degradation"
HEADLINE_UNDER = "Operational capacity is under-utilized — scheduling review recommended"
HEADLINE_NORMAL = "Operations within normal parameters — minor optimizations available"
NARRATIVE_SUMMARY = (
    "For the period %s, the organization tracked %d employees at %s%% utilization "
    "with %d support tickets raised (%d still open). Average ticket resolution time was "
    "%s hours with a %s%% SLA breach rate."
)

# --- insight cards: (title, body, severity, metric_key) -----------------------
INSIGHT_GAP = (
    "Staffing Gap Widening",
    "Demand rose %s%% week-over-week while staffing rose only %s%%. "
    "A %spp gap may strain capacity and increase SLA risk.",
    "alert", "staffing_gap",
)
INSIGHT_OVERSTAFFED = (
    "Over-Staffing Signal",
    "Staffing grew %s%% while demand grew only %s%%. Consider reviewing shift allocations.",
    "warning", "staffing_overage",
)
INSIGHT_UTIL_LOW = (
    "Low Workforce Utilization",
    "Average utilization is %s%% — below the 75%% operational target.",
    "warning", "utilization",
)
INSIGHT_UTIL_HIGH = (
    "Near-Capacity Utilization",
    "Average utilization at %s%%. Risk of burnout and quality degradation.",
    "alert", "utilization",
)
INSIGHT_UTIL_OK = (
    "Utilization On Target",
    "Workforce utilization is %s%% — within healthy operating range.",
    "info", "utilization",
)
INSIGHT_ABSENCE = (
    "Elevated Absence Rate",
    "Absence rate is %s%% — above the 8%% benchmark. Review coverage plans.",
    "warning", "absence_rate",
)
INSIGHT_VOLUME_UP = (
    "Ticket Volume Spike",
    "Support demand rose %s%% week-over-week. Investigate root cause.",
    "alert", "ticket_volume",
)
INSIGHT_VOLUME_DOWN = (
    "Ticket Volume Declining",
    "Ticket volume dropped %s%% week-over-week.",
    "info", "ticket_volume",
)
INSIGHT_BREACH = (
    "SLA Compliance At Risk",
    "%s%% of tickets breached SLA targets. Review critical and high priority response times.",
    "alert", "sla_breach",
)
INSIGHT_RESOLUTION = (
    "Slow Resolution Times",
    "Average resolution time is %s hours. Consider triaging backlog.",
    "warning", "resolution_time",
)

# --- executive summary lines --------------------------------------------------
EXECUTIVE_HEADER = "**Operations Summary**\n"
EXECUTIVE_UTILIZATION = "- Workforce utilization: **%s%%**"
EXECUTIVE_VOLUME = "- Ticket volume this week: **%d**"
EXECUTIVE_COMPLIANCE = "- SLA compliance: **%s%%**"
EXECUTIVE_ANOMALIES = "- Active anomalies flagged: **%d** — review recommended"

# --- loads ---------------------------------------------------------------------------------
#: Code and sentence of a record that could not be read, and the message of a run without a valid row.
MALFORMED = "malformed_row"
MALFORMED_DETAIL = "The record does not have the form that its header or document promises"
ALL_QUARANTINED = "100% quarantine rate — aborting. Check schema."

# --- reports of a detector -----------------------------------------------------------------
NO_METHOD = "none — insufficient data"
NOT_ENOUGH = "Not enough data for anomaly detection (minimum %d data points)."
