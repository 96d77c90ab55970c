"""The jobs: offline training and evaluation, serving, dashboard panels."""
