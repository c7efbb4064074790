"""The words of reports, classes and audit records, which results are compared by."""

SUMMARY = "Path risk: %s (score %.4f). Feasibility: %s. Traverse covers %.3f m across %d waypoints, drawing %.4f kWh of a %.1f kWh battery (%.4f kWh margin). "
WORST_SEGMENT = "Highest-hazard segment: %d at hazard %.4f."
NO_SEGMENT = "No high-hazard segments recorded."
REASON = "Hazard score %.4f at (%d, %d), local slope %.3f deg."
INFEASIBLE = "Do not execute: projected energy draw exceeds battery capacity. Shorten the traverse or select a lower-hazard corridor."
MARGIN_BEFORE, MARGIN_AFTER = "Execute with contingency planning: only ", " kWh of reserve remains."
FEASIBLE = "Execute as planned; energy reserve and hazard exposure are both within limits."
CRATER_RULE = "obstacle_area_fraction %.3f >= %.2f (few large closed features)"
SANDY_RULE = "low slope AND low roughness AND sparse obstacles"
ROCKY_RULE = "default (elevated slope, roughness, or obstacle count)"
RISK_FORMULA = "risk = w_hazard * mean(hazard along path) + w_energy * min(total_energy / battery_capacity, 1)"
HAZARD_FORMULA = "hazard = w_slope * min(slope_deg / slope_reference_deg, 1) + w_obstacle * 1/(1 + distance_to_obstacle_m) + w_roughness * normalised_local_std"
COST_FUNCTION = "distance_m * (1 + hazard) * (1 + k * |rise/run|)"
ENERGY_MODEL = "energy_kwh = energy_per_meter_kwh * distance_m * (1 + k * |rise/run|)"
HARD_CONSTRAINTS = "edge removed if |slope| > max_traversable_slope_deg or hazard >= lethal_hazard_threshold"
