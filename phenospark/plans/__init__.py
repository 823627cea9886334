"""Plans: the health-record view of the given tables and the steplist
compiler that folds a phenotype definition into one DataFrame plan."""
