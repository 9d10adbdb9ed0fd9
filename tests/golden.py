"""The published 40-row contact table, its findings, and the known answers to its open questions.

These are inputs and results that any engine of this kind has to agree on; they
are data, stated as they are published.
"""

# The table.
TABLE = """\
customer_id,full_name,email,phone,signup_date,country,revenue,status
1001,Ana María Torres,ana.torres@example.com,(555) 010-2233,2024-01-05,Mexico,1240.50,active
1002,Carlos Ruiz,carlos.ruiz@example.com,555-010-4411,2024-02-05,mexico,890.00,active
1003,Carlos Ruíz,carlos.ruiz@example.com,5550104411,05/02/2024,Mexico,890.00,active
1004,Lucía Fernández,lucia.fernandez@example,+52 555 010 8899,2024-02-14,Spain,2100.75,active
1005,John Smith,john.smith@example.com,555.010.7788,2024-03-01,USA,N/A,active
1005,John Smith,john.smith@example.com,555.010.7788,2024-03-01,USA,N/A,active
1007,Priya Nair,priya.nair@example.com,(555) 010-3344,2024-03-11,India,3420.00,active
1008,priya nair,priya.nair@exmaple.com,555 010 3344,11/03/2024,india,3420.00,active
1009,Tomás Álvarez,tomas.alvarez@example.com,(555) 010-9911,2024-04-02,Argentina,-450.00,active
1010,Mei Chen,mei.chen@example.com,,2024-04-18,China,1875.25,active
1011,Ahmed Hassan,ahmed.hassan@example.com,(555) 010-5566,2024-05-07,Egypt,980000.00,active
1012,Sofia Rossi,,(555) 010-2277,2024-05-21,Italy,1560.00,active
1013,Test User,test@test.com,(000) 000-0000,2024-06-01,unknown,0.00,active
1014,Marta Nowak,marta.nowak@example.com,+48 555 010 6677,06/15/2024,Poland,2340.10,ACTIVE
1015,Marta Novak,marta.nowak@example.com,+48 555 010 6677,2024-06-15,Poland,2340.10,active
1016,Kenji Tanaka,kenji.tanaka@example.com,(555) 010-8822,2024-07-03,Japan,"4120,00",active
1017,Olivia Brown,"olivia.brown@example,com",(555) 010-4499,2024-07-19,UK,1720.00,active
1018,Diego Morales,diego.morales@example.com,(555) 010-1122,2024-08-08,Chile,-,active
1019,Elena Petrova,elena.petrova@example.com,(555) 010-6633,2024-08-25,Russia,2890.40,Active
1020,Sam O'Neill,sam.oneill@example.com,(555) 010-7744,2024-09-09,Ireland,1130.90,active
1021,Sam ONeill,sam.oneill@example.com,5550107744,09/09/2024,ireland,1130.90,active
1022,Fatima Zahra,fatima.zahra@example.com,(555) 010-9955,2024-09-30,Morocco,unknown,active
1023,Lars Andersen,lars.andersen@example.com,(555) 010-3311,2024-10-12,Denmark,USD 2050.00,active
1024,N/A,,(555) 010-1199,2024-10-28,Brazil,760.00,active
1025,Yuki Sato,yuki.sato@example.com,(555) 010-2244,2024-11-05,Japan,1990.00,active
1026,Hans Müller,hans.mueller@example.com,+49 555 010 5533,11/20/2024,Germany,3310.60,active
1027,Amara Okafor,amara.okafor@example.com,(555) 010-8877,2024-12-02,Nigeria,abc,active
1028,Isabella Silva,isabella.silva@example.com,(555) 010-2255,2024-12-18,Brazil,2470.30,active
1029,Isabela Silva,isabella.silva@example.com,(555) 010-2255,2024-12-18,brazil,2470.30,active
1030,Chen Wei,chen.wei@example.com,(555) 010-6644,2025-01-13,China,1420.00,active
1031,Nadia Haddad,nadia.haddad@example.com,(555) 010-9933,2025-01-22,Lebanon,"1,680.50",active
1032,Peter Novak,peter.novak@example,(555) 010-4422,2025-02-08,Slovakia,2230.00,active
1033,Grace Kim,grace.kim@example.com,(555) 010-7733,2025-02-25,Korea,0,active
1033,Grace Kim,grace.kim@example.com,(555) 010-7733,2025-02-25,Korea,0,active
1035,Ravi Patel,ravi.patel@example.com,(555) 010-3355,2025-03-05,India,1450.00,active
1035,Ravi Patel,ravi.patel@example.com,(555) 010-3355,2025-03-05,India,1450.00,active
1037,Clara Dubois,clara.dubois@example.com,(555) 010-8811,2025-03-19,France,2680.00,active
1037,Clara Dubois,clara.dubois@example.com,(555) 010-8811,2025-03-19,France,2680.00,active
1039,Ana Maria Torres,ana.torres@example.com,(555) 010-2233,2024-01-05,Mexico,1240.50,active
1040,Ingrid Larsen,ingrid.larsen@example.com,(555) 010-5599,2025-04-02,Norway,3050.00,active
"""

# Findings by type, column and row; of two rows the later one comes first.
BY_RULE = {
    ("missing_value", "revenue"): "r-05 r-06 r-18 r-22",
    ("missing_value", "country"): "r-13",
    ("missing_value", "full_name"): "r-24",
    ("inconsistent_format", "phone"): "r-02 r-03 r-05 r-06 r-08 r-21",
    ("inconsistent_format", "signup_date"): "r-03 r-08 r-14 r-21 r-26",
    ("inconsistent_format", "country"): "r-02 r-08 r-21 r-29",
    ("inconsistent_format", "full_name"): "r-03 r-08 r-21 r-39",
    ("inconsistent_format", "status"): "r-14 r-19",
    ("type_mismatch", "revenue"): "r-16 r-23 r-31",
    ("outlier", "revenue"): "r-11",
    ("exact_duplicate", None): "r-06,r-05 r-34,r-33 r-36,r-35 r-38,r-37",
}
FOR_REVIEW = {
    ("missing_value", "email"): "r-12 r-24",
    ("missing_value", "phone"): "r-10",
    ("type_mismatch", "revenue"): "r-27",
    ("type_mismatch", "email"): "r-04 r-17 r-32",
    ("suspicious_value", "email"): "r-04 r-17 r-32",
    ("suspicious_value", "full_name"): "r-13",
    ("suspicious_value", "phone"): "r-13",
    ("fuzzy_duplicate", None): "r-03,r-02 r-08,r-07 r-15,r-14 r-21,r-20 r-29,r-28 r-39,r-01",
}

# Column, row, what is right, and the right value.
ANSWERS = [
    ("email", "r-12", "no_action", None),
    ("email", "r-24", "delete_row", None),
    ("phone", "r-10", "no_action", None),
    (None, "r-39", "delete_row", None),
    (None, "r-03", "delete_row", None),
    (None, "r-08", "delete_row", None),
    (None, "r-21", "delete_row", None),
    (None, "r-29", "delete_row", None),
    (None, "r-15", "delete_row", None),
    ("email", "r-17", "set_value", "olivia.brown@example.com"),
    ("email", "r-04", "set_value", "lucia.fernandez@example.com"),
    ("email", "r-32", "set_value", "peter.novak@example.com"),
    ("full_name", "r-13", "delete_row", None),
    ("revenue", "r-27", "no_action", None),
]
