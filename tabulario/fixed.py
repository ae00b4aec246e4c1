"""Fixed values of the service reports: bounds and labels of their classes, in the order in which they are tried.

Reports and oracle statements both build their CASE from these lists; the
conditions name the report's own columns.
"""

from __future__ import annotations

# Fixed values. name: ([(condition, label), ...], label of the rest)
CLASSES = {
    "nivel_problematico": ([
        ("promedio_duracion_min > 10 AND abandonados * 100 > frecuencia_journey * 70", "CRITICO"),
        ("promedio_pasos > 6 AND abandonados * 100 > frecuencia_journey * 50", "ALTO"),
        ("abandonados * 100 > frecuencia_journey * 30", "MEDIO"),
    ], "BAJO"),
    "clasificacion_abandono": ([
        ("veces_fue_punto_abandono * 100 > total_veces_visitado * 40 AND tiempo_promedio_antes_abandono_seg > 60", "PUNTO_CRITICO"),
        ("veces_fue_punto_abandono * 100 > total_veces_visitado * 25", "REQUIERE_ATENCION"),
    ], "NORMAL"),
    "recomendacion": ([
        ("sesiones_exitosas * 100 < total_sesiones * 50", "REDISEÑAR_FLUJO"),
        ("tiempo_promedio_exito_min > 8", "SIMPLIFICAR_PROCESO"),
        ("promedio_interacciones > 6", "REDUCIR_PASOS"),
    ], "OPTIMIZAR_CONTENIDO"),
    "nivel_riesgo": ([
        ("sesiones_exitosas = 0 AND dias_intentos >= 3", "CRITICO_CONTACTAR"),
        ("promedio_duracion_sesion > 12 AND sesiones_exitosas * 100 < total_sesiones * 40", "ALTO_RIESGO"),
        ("promedio_interacciones_por_sesion > 10", "MEDIO_RIESGO"),
    ], "BAJO_RIESGO"),
}

# Fixed values. Points that make up the frustration score, at most 100.
FRUSTRATION_POINTS = [
    ("promedio_duracion_sesion > 10", 25), ("promedio_interacciones_por_sesion > 8", 25), ("sesiones_exitosas * 100 < total_sesiones * 30", 30), ("dias_intentos > 3", 20),
]


def class_sql(name: str) -> str:
    """The CASE expression of a class."""
    rules, rest = CLASSES[name]
    return "CASE " + " ".join(f"WHEN {condition} THEN '{label}'" for condition, label in rules) + f" ELSE '{rest}' END"


def points_sql() -> str:
    """The frustration score."""
    return "least(100, " + " + ".join(f"CASE WHEN {condition} THEN {points} ELSE 0 END" for condition, points in FRUSTRATION_POINTS) + ")"
