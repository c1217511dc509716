"""They must equal the published rules for results to agree."""

EARTH_RADIUS_M = 6371008.8
AUTHALIC_RADIUS_M = 6371007.181
MERCATOR_HALF_M = 20037508.34
LOCAL_ZONE = "Europe/Madrid"
METRES_PER_DEGREE = 111000.0
DEGREE_SLACK = 1.2

HOTSPOT_SOURCES = ["VIIRS_NOAA20_SP", "VIIRS_SNPP_SP"]
HOTSPOT_REGIONS = ["peninsula_baleares", "canarias", "ceuta_melilla"]
HOTSPOT_EXPECTED_UNITS = 6
PUBLISHED_CONFIDENCE = ["n", "h"]
CONFIDENCE_ALIASES = {"low": "l", "l": "l", "nominal": "n", "n": "n", "high": "h", "h": "h"}
CONFIDENCE_LABELS = {"l": "baja", "n": "nominal", "h": "alta"}

LEVEL_WORDS_IMPORT = ["verde", "amarillo", "naranja", "rojo"]
LEVEL_WORDS_LIVE = ["rojo", "naranja", "amarillo", "verde"]
LEVEL_LABELS = {"verde": "Verde", "amarillo": "Amarillo", "naranja": "Naranja", "rojo": "Rojo"}
LEVEL_RANKS = {"Rojo": 3, "Naranja": 2, "Amarillo": 1}
LEVEL_COLORS = {"Rojo": "#CC0000", "Naranja": "#FFA500", "Amarillo": "#FFD700"}
LEVEL_COLOR_DEFAULT = "#4CAF50"
TEMPERATURE_PATTERN = r"(?i)(-?\d+(?:[,.]\d+)?)\s*(?:º|°)?\s*C"
FLOOD_WORDS = [
    "lluvia", "precipitación", "tormenta", "costero", "nieve derretida", "deshielo", "vaguada", "dana",
]
CAP_EVENT_NAME = "AEMET-Meteoalerta fenomeno"
CAP_LEVEL_NAME = "AEMET-Meteoalerta nivel"
CAP_PARAMETER_NAME = "AEMET-Meteoalerta parametro"
CAP_PROBABILITY_NAME = "AEMET-Meteoalerta probabilidad"
CAP_ZONE_NAME = "AEMET-Meteoalerta zona"

FWI_BOUNDS = [11.2, 21.3, 38.0, 50.0, 70.0]
DC_BOUNDS = [256.1, 334.1, 450.6, 600.0, 749.4]
DANGER_NAMES = ["Bajo", "Moderado", "Alto", "Muy alto", "Extremo", "Muy extremo"]

POPULATION_BOUNDS = [100, 500, 5000, 50000]
POPULATION_CLASSES = ["menor_100", "100_499", "500_4999", "5000_49999", "50000_mas"]

ROAD_SENTINELS = [-997, -998]
ROAD_CLASS_MIN_ZOOM = {
    "Autopista de peaje": 7,
    "Autopista libre / autovía": 7,
    "Carretera multicarril": 9,
    "Carretera convencional": 10,
    "Urbano": 14,
    "Urbano diseminado": 14,
    "Camino": 15,
    "Carril bici": 15,
    "Senda": 16,
}
ROAD_TOLERANCE_M = {7: 500.0, 8: 250.0, 9: 120.0, 10: 60.0, 11: 30.0, 12: 15.0, 13: 8.0, 14: 4.0}

BURNT_VERSIONS = ["v3", "v4"]
BURNT_FORMATS = ["cog", "nc"]
BURNT_DEFAULT_FROM, BURNT_DEFAULT_TO = "2025-05-01", "2025-08-31"

SANITIZE_MARK = "[SANITIZED]"
SANITIZE_MAX = 4000
SANITIZE_PATTERNS = [
    r"(?im)^\s*(?:system|assistant|tool)\s*:\s*$",
    r"(?im)^\s*<\|im_start\|>\s*(?:system|assistant|tool)",
    r"<\|[^|>\s]{1,40}\|>",
    r"(?i)</?(?:thinking|channel|im_start|im_end)[^>]*>",
    r"(?i)ignore\s+(?:all\s+|the\s+)?(?:previous|prior|above)\s+(?:instructions?|rules?|prompts?|messages?)",
    r"(?i)disregard\s+(?:all\s+|the\s+)?(?:above|previous|prior|system|instructions?)",
    r"(?i)forget\s+(?:everything|all|previous|the\s+above)",
    r"(?i)you\s+are\s+now\s+(?:a\s+)?(?:different|new|dan|jailbroken)",
]
REDACT_MARK = "[REDACTED]"
REDACT_PATTERNS = [
    r"\bsk-[A-Za-z0-9_\-]{16,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9_\-\.=]{16,}\b",
]
BLOCK_HEADERS = [
    ("interpretacion", "Consulta Interpretada"),
    ("operaciones", "Operaciones Geoespaciales"),
    ("resultados", "Resultados"),
    ("interpretacion_emergencia", "Interpretaci[oó]n para Emergencias"),
]
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"

GLOSSARY = [
    ("FRP", "FRP", "Fire Radiative Power"),
    ("FWI", "FWI", "Fire Weather Index"),
    ("DC", "DC", "Drought Code"),
    ("T10", "T=10", "Periodo de retorno 10 años (inundacion fluvial)"),
    ("CAP", "CAP", "Common Alerting Protocol"),
    ("VIIRS", "VIIRS", "Visible Infrared Imaging Radiometer Suite"),
    ("FIRMS", "FIRMS", "Fire Information for Resource Management System"),
    ("Burnt Area v4", "Burnt Area v4", "Copernicus CLMS Burnt Area, version 4"),
    ("CORINE", "CORINE Land Cover", "Coordination of Information on the Environment - Land Cover 2018"),
    ("AEMET", "AEMET", "Agencia Estatal de Meteorologia"),
]

PLACE_REGIONS = {
    "Andalucia": [-7.52, 35.99, -1.65, 38.73],
    "Aragon": [-2.18, 39.85, 0.78, 42.92],
    "Asturias": [-7.18, 42.88, -4.51, 43.66],
    "Cantabria": [-4.84, 42.71, -3.16, 43.51],
    "Castilla y Leon": [-7.07, 40.06, -1.66, 43.24],
    "Castilla-La Mancha": [-5.42, 38.04, -1.04, 41.34],
    "Cataluna": [0.16, 40.52, 3.34, 42.86],
    "Comunidad Valenciana": [-1.53, 37.84, 0.65, 40.79],
    "Extremadura": [-7.55, 37.95, -4.65, 40.49],
    "Galicia": [-9.31, 41.82, -6.74, 43.79],
    "La Rioja": [-3.13, 41.91, -1.68, 42.64],
    "Madrid": [-4.58, 39.88, -3.05, 41.17],
    "Murcia": [-2.34, 37.38, -0.65, 38.78],
    "Navarra": [-2.5, 41.91, -0.71, 43.32],
    "Pais Vasco": [-3.5, 42.46, -1.71, 43.5],
    "Canarias": [-18.2, 27.62, -13.4, 29.45],
    "Baleares": [1.16, 38.64, 4.34, 40.1],
    "Ceuta": [-5.4, 35.85, -5.25, 35.93],
    "Melilla": [-2.99, 35.25, -2.91, 35.36],
}

PLACE_PROVINCES = {
    "Almeria": [-3.16, 36.66, -1.65, 37.86],
    "Cadiz": [-6.49, 35.99, -4.66, 36.97],
    "Cordoba": [-5.61, 37.43, -4.18, 38.74],
    "Granada": [-4.2, 36.69, -2.32, 37.84],
    "Huelva": [-7.52, 36.95, -6.23, 38.27],
    "Jaen": [-4.36, 37.42, -2.16, 38.74],
    "Malaga": [-5.61, 36.3, -3.71, 37.29],
    "Sevilla": [-6.55, 36.78, -4.65, 38.07],
    "Huesca": [-0.91, 41.93, 0.78, 42.92],
    "Teruel": [-1.97, 40.07, -0.31, 41.34],
    "Zaragoza": [-2.18, 40.85, 0.38, 42.27],
    "Avila": [-5.78, 39.95, -4.4, 41.1],
    "Burgos": [-4.39, 41.65, -2.45, 43.16],
    "Leon": [-7.07, 42.13, -4.55, 43.24],
    "Palencia": [-4.99, 41.66, -3.92, 43.06],
    "Salamanca": [-7.06, 40.05, -4.83, 41.32],
    "Segovia": [-4.66, 40.66, -3.3, 41.41],
    "Soria": [-3.2, 41.16, -1.66, 42.13],
    "Valladolid": [-5.5, 41.2, -3.91, 42.18],
    "Zamora": [-7.06, 41.1, -5.04, 42.27],
    "Albacete": [-2.81, 38.04, -0.95, 39.36],
    "Ciudad Real": [-5.1, 38.3, -2.43, 39.62],
    "Cuenca": [-3.62, 39.04, -1.04, 40.79],
    "Guadalajara": [-4.05, 40.27, -1.46, 41.34],
    "Toledo": [-5.42, 39.42, -2.96, 40.42],
    "Barcelona": [0.95, 41.18, 3.34, 42.32],
    "Girona": [1.94, 41.59, 3.32, 42.86],
    "Lleida": [0.16, 41.2, 1.97, 42.86],
    "Tarragona": [0.2, 40.52, 1.94, 41.62],
    "Alicante": [-1.3, 37.84, 0.21, 38.97],
    "Castellon": [-0.92, 39.71, 0.65, 40.79],
    "Valencia": [-1.53, 38.74, 0.32, 40.13],
    "Badajoz": [-7.55, 37.95, -4.65, 39.5],
    "Caceres": [-7.55, 39.3, -4.95, 40.49],
    "Coruna": [-9.31, 42.55, -7.65, 43.79],
    "Lugo": [-7.95, 42.55, -6.74, 43.79],
    "Ourense": [-8.43, 41.82, -6.79, 42.69],
    "Pontevedra": [-9.04, 41.82, -7.95, 42.91],
    "Cantabria": [-4.84, 42.71, -3.16, 43.51],
    "La Rioja": [-3.13, 41.91, -1.68, 42.64],
    "Madrid": [-4.58, 39.88, -3.05, 41.17],
    "Murcia": [-2.34, 37.38, -0.65, 38.78],
    "Navarra": [-2.5, 41.91, -0.71, 43.32],
    "Alava": [-3.5, 42.45, -2.4, 43.16],
    "Gipuzkoa": [-2.61, 42.99, -1.71, 43.5],
    "Bizkaia": [-3.45, 43.04, -2.4, 43.5],
    "Asturias": [-7.18, 42.88, -4.51, 43.66],
    "Las Palmas": [-16.5, 27.62, -13.4, 29.45],
    "Santa Cruz de Tenerife": [-18.2, 27.62, -16.0, 28.85],
    "Baleares": [1.16, 38.64, 4.34, 40.1],
    "Ceuta": [-5.4, 35.85, -5.25, 35.93],
    "Melilla": [-2.99, 35.25, -2.91, 35.36],
}
