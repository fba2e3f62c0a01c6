"""Department CSV shapes: explicit schemas and column -> role bindings.

Each entry lists (CSV header, Spark type, role). Roles are the canonical
column names the packs read; a CSV read through ``read_department`` comes
out with role names, so the same pack code runs on CSV uploads and on
any other binding (see ``sources.testbed``).
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _DT = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

# Header names of the department datasets.
DEPARTMENTS: dict[str, list[tuple[str, T.DataType, str]]] = {
    "hr": [
        ("Employee_ID", _S, "employee_id"),
        ("Name", _S, "name"),
        ("Age", _I, "age"),
        ("Gender", _S, "gender"),
        ("Department", _S, "department"),
        ("Position", _S, "position"),
        ("Date_Hired", _S, "date_hired"),          # dd/MM/yyyy text, parsed explicitly
        ("Employment_Type", _S, "employment_type"),
        ("Monthly_Salary", _I, "salary"),
        ("Performance_Score", _I, "performance"),
        ("Training_Hours", _I, "training_hours"),
        ("Leave_Days_Taken", _I, "leave_days"),
        ("Overtime_Hours", _I, "overtime_hours"),
        ("Resigned", _S, "resigned_text"),
    ],
    "it": [
        ("Employee ID", _I, "ticket_id"),
        ("System Name", _S, "system"),
        ("Issue Reported", _S, "issue"),
        ("Reported Date", _DT, "reported_at"),
        ("Resolution Time (hrs)", _D, "hours"),
        ("Technician Assigned", _S, "technician"),
        ("Status", _S, "status"),
    ],
    "production": [
        ("Production_ID", _S, "production_id"),
        ("Product_Name", _S, "product"),
        ("Units_Produced", _I, "units"),
        ("Defective_Units", _I, "defects"),
        ("Production_Line", _S, "line"),
        ("Shift", _S, "shift"),
        ("Start_Time", _S, "start_time"),
        ("End_Time", _S, "end_time"),
        ("Downtime_Minutes", _I, "downtime_minutes"),
        ("Machine_Utilization_%", _D, "utilization"),
        ("Labor_Hours", _I, "labor_hours"),
        ("Supervisor", _S, "supervisor"),
        ("Date", _DT, "date"),
    ],
    "sales": [
        ("Product", _S, "product"),
        ("Region", _S, "region"),
        ("Salesperson", _S, "salesperson"),
        ("Date", _DT, "date"),
        ("Revenue", _D, "revenue"),
        ("Units Sold", _I, "units"),
    ],
    "marketing": [
        ("Campaign ID", _S, "campaign_id"),
        ("Campaign Type", _S, "campaign_type"),
        ("Start Date", _DT, "start_date"),
        ("End Date", _DT, "end_date"),
        ("Budget ($)", _D, "budget"),
        ("Channel", _S, "channel"),
        ("Region", _S, "region"),
        ("Leads Generated", _I, "leads"),
        ("Conversion Rate (%)", _D, "conversion_rate"),
        ("Revenue Generated ($)", _D, "revenue"),
    ],
    "finance": [],                                  # stored as uploaded, no typed columns
    "supply_chain": [
        ("Procurement ID", _S, "procurement_id"),
        ("Item Name", _S, "item"),
        ("Category", _S, "category"),
        ("Supplier", _S, "supplier"),
        ("Order Quantity", _I, "quantity"),
        ("Unit Cost (USD)", _D, "unit_cost"),
        ("Total Cost (USD)", _D, "total_cost"),
        ("Order Date", _DT, "order_date"),
        ("Delivery Date", _DT, "delivery_date"),
        ("Procurement Status", _S, "status"),
    ],
    "transport": [
        ("Employee ID", _S, "employee_id"),
        ("Employee Name", _S, "employee_name"),
        ("Role", _S, "role"),
        ("Date of Entry", _DT, "entry_date"),
        ("Number of Deliveries per Week", _I, "deliveries"),
        ("Average Delivery Time (hrs)", _D, "delivery_time"),
        ("Vehicle Type", _S, "vehicle"),
        ("Vehicle Condition Score", _I, "condition"),
        ("Fuel Consumption (L/week)", _D, "fuel"),
        ("Maintenance Cost ($/month)", _D, "maintenance"),
        ("On-time Delivery Rate (%)", _D, "on_time_rate"),
        ("Incidents Reported", _I, "incidents"),
        ("Shift", _S, "shift"),
    ],
}

# Dataset kinds accepted by the intake form, mapped to department shapes.
DATASET_TYPES = {
    "hr": "hr",
    "it": "it",
    "production": "production",
    "sales": "sales",
    "finance": "finance",
    "marketing": "marketing",
    "supply_chain": "supply_chain",
    "transport": "transport",
}


def csv_schema(department: str) -> T.StructType:
    """Schema in CSV header names (what ``spark.read.csv`` needs)."""
    return T.StructType([T.StructField(h, t, True) for h, t, _ in DEPARTMENTS[department]])


def role_names(department: str) -> dict[str, str]:
    """CSV header -> role."""
    return {h: r for h, _, r in DEPARTMENTS[department]}
