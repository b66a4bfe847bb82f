"""legajo: administrative-document analytics as Spark plans."""
