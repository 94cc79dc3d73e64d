"""Plans: whole studies, screens and reports composed of operators, and the registered queries."""
