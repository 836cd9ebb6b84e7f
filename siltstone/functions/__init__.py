"""siltstone functions"""
