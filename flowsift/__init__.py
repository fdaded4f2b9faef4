"""Connection triage on Spark: validate, encode, score, explain, ticket, review, retrain, evaluate."""
