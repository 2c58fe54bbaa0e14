"""Plans that run over many jobs: fitting a model."""
