"""The statement of the acceptance tests: 46 rows of four months.

Fixed acceptance values: dates, texts and amounts are those that the acceptance results are given for.
"""

from datetime import date

ROWS = [
    ("t01", date(2026, 1, 5), "DEB AUTOR IMOBILIARIA SOLAR", -4500.0),
    ("t02", date(2026, 1, 5), "SISPAG CLIENTE ALFA RETAINER", 12000.0),
    ("t03", date(2026, 1, 6), "PIX TRANSF CONTABILIDADE ALFA 06/01", -480.0),
    ("t04", date(2026, 1, 7), "DA RECEITA FEDERAL 12345678000199", -1850.0),
    ("t05", date(2026, 1, 8), "GOOGLE WORKSPACE BUSINESS", -129.9),
    ("t06", date(2026, 1, 9), "DA VIVO FIBRA 301389120", -289.9),
    ("t07", date(2026, 1, 10), "PIX TRANSF ACME CLOUD 10/01", -399.9),
    ("t08", date(2026, 1, 11), "PIX TRANSF NOTEBOOK PARCELA 01/06 11/01", -900.0),
    ("t09", date(2026, 1, 12), "PIX TRANSF META ADS 12/01", -850.0),
    ("t10", date(2026, 1, 13), "PIX TRANSF MERCADO CENTRAL 13/01", -220.0),
    ("t11", date(2026, 1, 14), "PIX TRANSF CLIENTE EVENTUAL 14/01", 2300.0),
    ("t12", date(2026, 1, 15), "PIX TRANSF ERP LEGACY 15/01", -610.0),
    ("t13", date(2026, 1, 16), "PIX TRANSF RECEITA ERRADA 16/01", -100.0),
    ("t14", date(2026, 2, 5), "DEB AUTOR IMOBILIARIA SOLAR", -4500.0),
    ("t15", date(2026, 2, 5), "SISPAG CLIENTE ALFA RETAINER", 12150.0),
    ("t16", date(2026, 2, 6), "PIX TRANSF CONTABILIDADE ALFA 06/02", -490.0),
    ("t17", date(2026, 2, 7), "DA RECEITA FEDERAL 12345678000199", -1900.0),
    ("t18", date(2026, 2, 8), "GOOGLE WORKSPACE BUSINESS", -129.9),
    ("t19", date(2026, 2, 9), "DA VIVO FIBRA 301389120", -319.9),
    ("t20", date(2026, 2, 10), "PIX TRANSF ACME CLOUD 10/02", -399.9),
    ("t21", date(2026, 2, 11), "PIX TRANSF NOTEBOOK PARCELA 02/06 11/02", -900.0),
    ("t22", date(2026, 2, 12), "PIX TRANSF META ADS 12/02", -900.0),
    ("t23", date(2026, 2, 13), "ITAU BLACK 3111-7157", -3400.0),
    ("t24", date(2026, 2, 14), "JUROS LIMITE DA CONTA", -160.0),
    ("t25", date(2026, 2, 17), "PIX TRANSF DUPLICIDADE ACME - 17/02", -750.0),
    ("t26", date(2026, 2, 17), "PIX TRANSF DUPLICIDADE ACME 17/02", -750.0),
    ("t27", date(2026, 3, 5), "DEB AUTOR IMOBILIARIA SOLAR", -4500.0),
    ("t28", date(2026, 3, 5), "SISPAG CLIENTE ALFA RETAINER", 11950.0),
    ("t29", date(2026, 3, 6), "PIX TRANSF CONTABILIDADE ALFA 06/03", -485.0),
    ("t30", date(2026, 3, 7), "DA RECEITA FEDERAL 12345678000199", -1920.0),
    ("t31", date(2026, 3, 8), "GOOGLE WORKSPACE BUSINESS", -129.9),
    ("t32", date(2026, 3, 9), "DA VIVO FIBRA 301389120", -305.9),
    ("t33", date(2026, 3, 10), "PIX TRANSF ACME CLOUD 10/03", -399.9),
    ("t34", date(2026, 3, 11), "PIX TRANSF NOTEBOOK PARCELA 03/06 11/03", -900.0),
    ("t35", date(2026, 3, 12), "DA COPEL ENERGIA 90001", -410.0),
    ("t36", date(2026, 3, 18), "PIX TRANSF CONTA PROPRIA 18/03", -1200.0),
    ("t37", date(2026, 3, 22), "PIX TRANSF FOLHA EMPRESA 22/03", -6800.0),
    ("t38", date(2026, 4, 5), "DEB AUTOR IMOBILIARIA SOLAR", -4500.0),
    ("t39", date(2026, 4, 5), "SISPAG CLIENTE ALFA RETAINER", 12200.0),
    ("t40", date(2026, 4, 6), "PIX TRANSF CONTABILIDADE ALFA 06/04", -500.0),
    ("t41", date(2026, 4, 7), "DA RECEITA FEDERAL 12345678000199", -1880.0),
    ("t42", date(2026, 4, 8), "GOOGLE WORKSPACE BUSINESS", -129.9),
    ("t43", date(2026, 4, 9), "DA VIVO FIBRA 301389120", -329.9),
    ("t44", date(2026, 4, 10), "PIX TRANSF ACME CLOUD 10/04", -399.9),
    ("t45", date(2026, 4, 11), "PIX TRANSF NOTEBOOK PARCELA 04/06 11/04", -900.0),
    ("t46", date(2026, 4, 14), "CREDIARIO ITAU 73955", 7000.0),
]


def statement():
    """(id, date, text, amount) in the order of the statement."""
    return list(ROWS)
