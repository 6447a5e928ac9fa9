"""Column expressions: features, scoring bands, decisions and loan maths."""
