"""siltstone operators"""
