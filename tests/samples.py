"""Small sensor CSV files for the source and job tests, made from a rule: each
column walks through its range with a step of its own."""

import csv

#: file -> (rows, repeated rows, {column: (lowest, highest)})
FILES = {
    "temperature.csv": (40, 4, {"temp_current": (40, 95), "vibration_x": (1, 9), "vibration_y": (1, 9), "vibration_z": (1, 8),
                                "current": (5, 14), "voltage": (220, 240), "pressure": (90, 110), "humidity": (30, 70)}),
    "pump.csv": (30, 0, {"flow": (60, 150), "head": (41, 59), "power": (5, 15), "vibration": (0, 10)}),
    "leak.csv": (50, 0, {"pressure": (0.4, 0.9), "supply_flow": (450, 560), "demand_flow": (400, 440)}),
    "belt_fault.csv": (33, 3, {"current": (100, 140), "speed_diff": (0, 0.8), "vibration_motor": (1, 9),
                               "temperature_bearing": (40, 100), "current_std": (1, 15)}),
    "belt_slip.csv": (28, 0, {"current": (90, 140), "speed_diff": (0, 0.8), "vibration": (1, 10), "temperature": (40, 100)}),
    "inverter.csv": (25, 0, {"mean_ripple": (1, 5), "std_ripple": (0.1, 1), "mean_temp": (50, 95), "temp_rise": (0, 9),
                             "mean_load": (0.2, 1), "temp_range": (5, 30)}),
}


def write_samples(folder: str) -> str:
    for name, (rows, repeated, ranges) in FILES.items():
        table = []
        for i in range(rows - repeated):
            row = {c: round(lo + (hi - lo) * ((i * (37 + 14 * k) + 11 * k) % 101) / 100, 3)
                   for k, (c, (lo, hi)) in enumerate(ranges.items())}
            if name == "leak.csv":
                row["flow_diff"] = round(row["supply_flow"] - row["demand_flow"], 3)
                row["flow_ratio"] = round(row["supply_flow"] / row["demand_flow"], 3)
            table.append(row)
        with open(f"{folder}/{name}", "w", newline="") as f:
            w = csv.DictWriter(f, list(table[0]))
            w.writeheader()
            w.writerows(table + table[:repeated])
    return folder
