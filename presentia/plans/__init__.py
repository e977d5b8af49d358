"""Plan helpers shared by the operators: materialised steps and sizing."""
