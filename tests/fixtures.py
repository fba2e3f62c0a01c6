"""Small invented department CSVs (same headers as the department shapes).

Edge cases: null group key, tied dates at the top-N cut, zero units,
delivery before order, quoted comma, the text ``None``, one-class label.
The header lines are fixed values.
"""

SUPPLY = """Procurement ID,Item Name,Category,Supplier,Order Quantity,Unit Cost (USD),Total Cost (USD),Order Date,Delivery Date,Procurement Status
p1,Bolts,Machinery,"Acme, Inc",10,2.5,25.0,2024-01-05,2024-01-10,Received
p2,Paper,Office Supplies,Beta Ltd,100,0.5,50.0,2024-01-20,2024-01-18,Ordered
p3,Chips,Electronics,"Acme, Inc",5,20.0,100.0,2024-02-01,2024-02-11,Completed
p4,Tape,Packaging,Gamma Co,40,1.25,50.0,2024-02-14,2024-02-14,Pending
p5,Steel,Raw Materials,Beta Ltd,7,30.0,210.0,2024-02-14,2024-03-01,Cancelled
p6,Pens,,Gamma Co,20,1.0,20.0,2024-03-02,2024-02-28,Completed
"""

IT = """Employee ID,System Name,Issue Reported,Reported Date,Resolution Time (hrs),Technician Assigned,Status
1001,ERP,Login failure,2024-01-03,0.5,Ann,Resolved
1002,CRM,Slow response,2024-01-15,12.0,Bob,Closed
1003,ERP,Login failure,2024-02-01,4.0,Cid,Pending
1004,Mail,Update failure,2024-02-01,1.0,Dan,Escalated
1005,CRM,Update failure,2024-03-09,30.0,Eve,In Progress
1006,ERP,Update failure,2024-03-09,2.0,Fay,Resolved
"""

PRODUCTION = """Production_ID,Product_Name,Units_Produced,Defective_Units,Production_Line,Shift,Start_Time,End_Time,Downtime_Minutes,Machine_Utilization_%,Labor_Hours,Supervisor,Date
P1,Widget,1000,10,Line 1,Morning,06:00,14:00,5,90.0,12,J. Doe,2024-04-01
P2,Gadget,800,0,Line 2,Evening,14:00,22:00,0,95.5,14,A. Roe,2024-04-02
P3,Widget,1200,24,Line 1,Night,22:00,06:00,30,88.0,16,J. Doe,2024-05-01
P4,Gizmo,0,0,Line 3,Morning,06:00,14:00,10,85.0,12,B. Poe,2024-05-01
"""

SALES = """Product,Region,Salesperson,Date,Revenue,Units Sold
A,North,Kim,2024-01-02,100.0,10
B,South,Lee,2024-01-20,300.0,5
A,North,Lee,2024-02-03,50.0,5
C,East,Kim,2024-02-03,25.0,1
"""

TRANSPORT = """Employee ID,Employee Name,Role,Date of Entry,Number of Deliveries per Week,Average Delivery Time (hrs),Vehicle Type,Vehicle Condition Score,Fuel Consumption (L/week),Maintenance Cost ($/month),On-time Delivery Rate (%),Incidents Reported,Shift
TL1,Al,Driver,2024-01-10,10,2.0,Van,7,50.0,100.0,90.0,1,Morning
TL2,Bo,Courier,2024-01-20,20,4.0,None,5,20.0,50.0,80.0,0,Night
TL3,Cy,Driver,2024-02-05,30,3.0,Truck,9,150.0,400.0,95.0,2,Evening
TL4,Di,Manager,2024-02-25,5,6.0,None,3,30.0,70.0,70.0,0,Rotational
"""

HR = """Employee_ID,Name,Age,Gender,Department,Position,Date_Hired,Employment_Type,Monthly_Salary,Performance_Score,Training_Hours,Leave_Days_Taken,Overtime_Hours,Resigned
HR0001,A,30,Female,HR,Recruiter,05/01/2020,Full-Time,5000,5,40,2,10,No
HR0002,B,40,Male,HR,HR Manager,15/03/2019,Contract,9000,2,10,20,5,Yes
HR0003,C,25,Other,HR,Recruiter,01/12/2021,Part-Time,3000,1,80,25,0,Yes
HR0004,D,50,Female,HR,HR Officer,20/06/2018,Full-Time,7000,4,10,5,20,No
HR0005,E,35,Male,HR,HR Assistant,10/10/2022,Full-Time,4000,3,60,10,15,No
"""

MARKETING = """Campaign ID,Campaign Type,Start Date,End Date,Budget ($),Channel,Region,Leads Generated,Conversion Rate (%),Revenue Generated ($)
c1,Email,2024-05-13,2025-05-13,1000.0,Online,North,100,5.0,4000.0
c2,TV,2024-06-01,2025-05-13,5000.0,Retail,South,200,2.5,6000.0
c3,Email,2024-07-01,2025-05-13,2000.0,Retail,East,50,10.0,1000.0
"""

ALL = {"supply_chain": SUPPLY, "it": IT, "production": PRODUCTION, "sales": SALES,
       "transport": TRANSPORT, "hr": HR, "marketing": MARKETING}


def write(tmp_path, department: str) -> str:
    p = tmp_path / f"{department}.csv"
    p.write_text(ALL[department])
    return str(p)
