"""Synthetic document texts."""

FRONT = """APELLIDOS
PRUEBA EJEMPLO
NOMBRE
ANA
DNI
12345678Z
SEXO
D
NACIONALIDAD
ESP
FECHA DE NACIMIENTO
15 06 1980
VALIDEZ
01/01/2020 01/01/2035"""

ZONE = "\n".join(x.ljust(30, "<") for x in ("IDESPAAA000000012345678Z", "8006155F3501017ESP", "PRUEBA<EJEMPLO<<ANA"))

VEHICLE = """A 1234BCF
E 1M8GDM9AXKP042788
D.1
SEAT
D.3
SEAT IBIZA
P.1
1490
P.2
92
P.3
GASOLINA
S.1
5
C.1.1
PRUEBA EJEMPLO
C.1.2
ANA
I
08/08/2024"""

CARD = """A58818501
Denominación
EMPRESA PRUEBA, S.L.
Domicilio Fiscal
CALLE MAYOR, NUM. 5, PLANTA 0, PUERTA 3
28001 MADRID
MADRID
Fecha N.I.F. Definitivo
26-07-2016
Administración AEAT
28601 MADRID"""
