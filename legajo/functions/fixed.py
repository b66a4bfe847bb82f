"""Fixed values of the document formats: alphabets, weights, place and brand names, labels."""

from __future__ import annotations

# Control letters of person ids (by number mod 23) and of company ids (by control digit).
PERSON_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
COMPANY_LETTERS = "JABCDEFGHI"
COMPANY_HEADS = "ABCDEFGHJKLMNPQRSUVW"
COMPANY_DIGIT_ONLY, COMPANY_LETTER_ONLY = "ABEH", "KPQS"
PLATE_LETTERS = "BCDFGHJKLMNPRSTVWXYZ"

# Vehicle identification numbers, weights by position and values of the letters (letters and digits, in pairs).
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_LETTERS, VIN_VALUES = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"

# Letters that OCR confuses with digits, and back.
PLATE_DIGITS = ("OISBZG", "015826")
PLATE_ENDINGS = ("081", "OBI")
ID_DIGITS = ("OISBZ", "01582")

# Province names as printed, without and with the islands.
PROVINCES = (
    "BARCELONA", "TARRAGONA", "LLEIDA", "GIRONA", "MADRID", "VALENCIA", "ALICANTE", "CASTELLON", "CASTELLÓ",
    "SEVILLA", "MALAGA", "MÁLAGA", "CADIZ", "CÁDIZ", "HUELVA", "CORDOBA", "CÓRDOBA", "GRANADA", "JAEN", "JAÉN",
    "ALMERIA", "ALMERÍA", "ZARAGOZA", "HUESCA", "TERUEL", "A CORUÑA", "LA CORUÑA", "CORUÑA", "PONTEVEDRA",
    "OURENSE", "LUGO", "VIZCAYA", "BIZKAIA", "GUIPUZCOA", "GIPUZKOA", "ALAVA", "ARABA", "NAVARRA", "LA RIOJA",
    "RIOJA", "CANTABRIA", "ASTURIAS", "MURCIA", "BADAJOZ", "CACERES", "CÁCERES", "SALAMANCA", "ZAMORA",
    "VALLADOLID", "LEON", "LEÓN", "PALENCIA", "BURGOS", "SORIA", "SEGOVIA", "AVILA", "ÁVILA", "TOLEDO",
    "CIUDAD REAL", "CUENCA", "GUADALAJARA", "ALBACETE",
)
ISLANDS = ("PALMAS, LAS", "SANTA CRUZ DE TENERIFE", "TENERIFE", "BALEARES", "BALEARS", "ILLES BALEARS")
VEHICLE_PROVINCES = (
    "BARCELONA", "MADRID", "RIOJA (LA)", "LA RIOJA", "TARRAGONA", "GIRONA", "LLEIDA", "VALENCIA", "ALICANTE", "SEVILLA",
    "MALAGA", "CADIZ", "ZARAGOZA", "BILBAO", "VIZCAYA", "GUIPUZCOA", "NAVARRA", "MURCIA", "ASTURIAS", "CANTABRIA",
)

# Vehicle brands in the order they are tried, and the models that some brands are known for.
BRANDS = (
    "SEAT", "VOLKSWAGEN", "VW", "RENAULT", "PEUGEOT", "CITROEN", "CITROËN", "FORD", "OPEL", "FIAT", "AUDI", "BMW",
    "MERCEDES", "MERCEDES-BENZ", "TOYOTA", "NISSAN", "HYUNDAI", "KIA", "MAZDA", "HONDA", "SUZUKI", "DACIA", "SKODA",
    "VOLVO", "LAND ROVER", "JEEP", "MITSUBISHI", "SUBARU", "LEXUS", "ALFA ROMEO", "LANCIA", "PORSCHE", "MINI",
    "SMART", "TESLA", "POLESTAR", "CUPRA",
)
MODELS = {
    "TOYOTA": ("YARIS", "COROLLA", "AURIS", "AVENSIS", "RAV4", "PRIUS", "HILUX", "C-HR", "CAMRY"),
    "SEAT": ("IBIZA", "LEON", "ARONA", "ATECA", "TARRACO", "ALHAMBRA", "MII", "TOLEDO"),
    "VOLKSWAGEN": ("GOLF", "POLO", "PASSAT", "TIGUAN", "TOUAREG", "T-ROC", "ID.3", "ID.4"),
    "RENAULT": ("CLIO", "MEGANE", "CAPTUR", "KADJAR", "SCENIC", "ZOE", "ARKANA"),
    "PEUGEOT": ("208", "308", "3008", "5008", "107", "206", "207", "407", "508"),
    "FORD": ("FIESTA", "FOCUS", "MONDEO", "KUGA", "PUMA", "MUSTANG", "TRANSIT"),
    "BMW": ("SERIE 1", "SERIE 2", "SERIE 3", "SERIE 5", "X1", "X3", "X5"),
    "AUDI": ("A1", "A3", "A4", "A6", "Q2", "Q3", "Q5", "Q7", "TT"),
    "MERCEDES": ("CLASE A", "CLASE B", "CLASE C", "CLASE E", "GLA", "GLB", "GLC"),
    "KIA": ("PICANTO", "RIO", "CEED", "SPORTAGE", "SORENTO", "NIRO", "STONIC"),
    "HYUNDAI": ("I10", "I20", "I30", "TUCSON", "SANTA FE", "IONIQ", "KONA"),
    "HONDA": ("JAZZ", "CIVIC", "CR-V", "HR-V", "ACCORD"),
    "NISSAN": ("MICRA", "JUKE", "QASHQAI", "X-TRAIL", "LEAF", "NAVARA"),
    "OPEL": ("CORSA", "ASTRA", "INSIGNIA", "MOKKA", "CROSSLAND", "GRANDLAND"),
    "DACIA": ("SANDERO", "DUSTER", "LOGAN", "SPRING", "JOGGER"),
    "SKODA": ("FABIA", "OCTAVIA", "SUPERB", "KODIAQ", "KAROQ", "SCALA"),
    "FIAT": ("PUNTO", "PANDA", "500", "TIPO", "BRAVO", "DUCATO"),
}

# Readable vehicle type of each approval category.
CATEGORIES = {
    "M1": "Turisme",
    "M2": "Autobús lleuger",
    "M3": "Autobús pesant",
    "N1": "Furgoneta",
    "N2": "Camió mitjà",
    "N3": "Camió pesant",
    "L1E": "Ciclomotor",
    "L2E": "Ciclomotor 3 rodes",
    "L3E": "Motocicleta",
    "L4E": "Motocicleta sidecar",
    "L5E": "Tricicle motor",
    "L6E": "Quadricicle lleuger",
    "L7E": "Quadricicle pesant",
}

# Words whose presence in a line ends a field of an identity card, its address, or a fiscal address.
FIELD_STOPS = (
    "APELLIDOS", "COGNOMS", "NOMBRE", "NOM", "SEXO", "SEXE", "NACIONALIDAD", "NACIONALITAT", "FECHA", "DATA",
    "DOMICILIO", "DOMICILI", "LUGAR", "LLOC", "PADRE", "PARE", "MADRE", "MARE", "DNI", "EQUIPO", "EQUIP", "IDNUM",
)
ADDRESS_STOPS = ("FECHA", "DATA", "LUGAR DE NACIMIENTO", "LLOC DE NAIXEMENT", "PADRE", "PARE", "MADRE", "MARE", "EQUIPO", "EQUIP", "HIJO", "FILL", "IDNUM", "TEAM")
ADDRESS_LABELS = ("LUGAR DE DOMICILIO", "LLOC DE DOMICILI", "PROVINCIA/PAÍS", "PROVINCIA-PAÍS", "PROVÍNCIA-PAÍS")
FISCAL_STOPS = ("DOMICILIO", "FECHA", "ADMINISTRACIÓN", "ADMINISTRACION", "CÓDIGO", "CODIGO", "ANAGRAMA", "N.I.F", "NIF")

# Words of the back and the front of identity cards, and words that tell a document's family, in the order of the families.
BACK_WORDS = ("DOMICILIO", "DOMICILI", "EQUIPO", "EQUIP", "HIJO", "FILL", "PADRE", "PARE", "MADRE", "MARE", "LUGAR DE NACIMIENTO")
FRONT_WORDS = ("APELLIDOS", "COGNOMS", "SEXO", "SEXE", "NACIONALIDAD", "NACIONALITAT")
FAMILY_WORDS = {
    "dni": ("IDESP", "APELLIDOS", "COGNOMS", "DOCUMENTO NACIONAL", "NACIONALIDAD"),
    "nif": ("DENOMINACI", "DOMICILIO FISCAL", "N.I.F", "AEAT"),
    "permiso_circulacion": ("PERMISO DE CIRCULACI", "D.1", "P.1", "C.1.1"),
}
