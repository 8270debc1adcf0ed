"""Plans: whole assessments built from the operators."""
