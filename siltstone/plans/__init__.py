"""siltstone plans"""
